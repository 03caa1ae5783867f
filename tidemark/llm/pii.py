"""Personal data replaced by surrogates, with DataFrame functions only.

Detected entities get a keyed replacement of their type: letters stand for letters of their script and case (vowels for
vowels), digits for digits, addresses stay addresses, card numbers keep a valid check digit, titled names keep their title
and the last letter of each part and with them their gender. All mentions of one entity, in any layout or case, get one surrogate. A
surrogate that is another entity's, or is itself found in the texts, is drawn again until all are distinct; after ``PLAIN``
attempts from wider alphabets and with letters or digits added, one more at each attempt, so that the draws come to an end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import documents, query
from tidemark.llm.tables import written

_IN, _OUT = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
#: Titles that tell a gender, by gender.
TITLES = {"name_m": r"(?:Mr\.?|Herr|Señor|Sr\.|Monsieur)", "name_f": r"(?:Mrs\.?|Ms\.?|Frau|Señora|Sra\.|Madame|Mme)"}
_NAME = r"\s\p{Lu}\p{Ll}+(?:[ -]\p{Lu}\p{Ll}+)?"
#: Kinds of entities in the order in which they are tried.
KINDS = {
    "email": rf"{_IN}[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{{2,}}{_OUT}",
    "phone": rf"(?<![\w+])\+[0-9]{{1,3}}[ .-]?(?:\([0-9]{{2,4}}\)|[0-9]{{2,4}})[ .-]?[0-9]{{3,4}}[ .-]?[0-9]{{3,4}}(?![0-9])",
    "ip": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9.-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])",
    "access_key": rf"{_IN}A(?:KIA|SIA)[A-Z0-9]{{16}}{_OUT}",
    "secret": rf"(?<=password=)[^\s\"']{{6,}}|(?<=[=:] ?\")[0-9A-Za-z_/+-]{{20,}}(?=\")|{_IN}[0-9a-f]{{32,64}}{_OUT}",
} | {k: rf"(?<!\w){t}{_NAME}" for k, t in TITLES.items()}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
#: Whether a text can hold an entity at all; cheap, and true of every text with a match of ``ANY``.
SOME = r"[0-9@]|password=|[=:] ?\"|A(?:KIA|SIA)[A-Z]{16}|[a-f]{32}|(?<!\w)(?:" + "|".join(TITLES.values()) + r")\s"
#: Letters drawn from, by class: vowels and others, lower and upper case, by script; plain text in alphabetical order.
ALPHABETS = (
    "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "0123456789",
    "аеиоуэюя", "бвгджзклмнпрстфхцчш", "АЕИОУЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШ",
    "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ", "áéíóúàèùâêîôûäöüñç",
)
#: Attempts within the length and the alphabets of an entity, and letters or digits that the next one adds.
PLAIN, ADDED = 6, 4


def kind_of(mention: Column) -> Column:
    """Kind of a mention; null for a number that is no card."""
    out = F.lit(None).cast("string")
    for kind in reversed(KINDS):
        hit = mention.rlike(rf"^(?:{KINDS[kind]})$" if kind != "secret" else r"^[^\s\"']+$")
        out = F.when(hit, F.when(luhn(mention), kind) if kind == "card" else kind).otherwise(out)
    return out


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn_sum(number: Column, first_doubled: int) -> Column:
    """Sum of digits from the right, every other one doubled."""
    places = F.filter(F.split(F.reverse(number), ""), lambda c: c != "")
    values = F.transform(places, lambda c, i: F.when((i + first_doubled) % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def luhn(mention: Column) -> Column:
    d = digits(mention)
    return (F.length(d) >= 13) & (luhn_sum(d, 1) % 10 == 0)


def canonical(kind: Column, mention: Column) -> Column:
    """What mentions of one entity have in common."""
    name = F.lower(F.regexp_replace(mention, r"^\S+\s", ""))
    return F.when(kind == "email", F.lower(mention)).when(kind.isin("phone", "card", "ssn"), digits(mention)).when(kind.startswith("name_"), name).otherwise(mention)


def drawn(secret: str, kind: Column, entity: Column, attempt: Column, i: Column) -> Column:
    """A keyed number for a place of an entity."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\x01", F.lit(secret), kind, entity, attempt.cast("string"), i.cast("string"), F.lit(secret)), 256), 1, 12), 16, 10).cast("long")


def surrogate(secret: str, kind: Column, entity: Column, attempt: Column) -> Column:
    """Replacement of a canonical entity, of its length but for addresses and for what has no free surrogate of its length."""
    places = F.filter(F.split(entity, ""), lambda c: c != "")
    hexes = entity.rlike("^[0-9a-f]+$") & (kind == "secret")
    wide = attempt >= PLAIN
    numbers = kind.isin("phone", "card", "ssn", "ip")
    letters = F.when(numbers, "0123456789").when(hexes, "0123456789abcdef").when(kind == "access_key", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    letters = letters.when(entity.rlike(r"\p{IsCyrillic}"), "абвгдежзиклмнопрстуфхцчшэюя").when(entity.rlike(r"\p{IsGreek}"), "αβγδεζηθικλμνξοπρτυφχψω").otherwise("abcdefghijklmnopqrstuvwxyz")

    def letter(i: Column) -> Column:
        return F.substring(letters, F.pmod(drawn(secret, kind, entity, attempt, i), F.length(letters)).cast("int") + 1, F.lit(1))

    def place(c: Column, i: Column) -> Column:
        n = drawn(secret, kind, entity, attempt, i)
        out = c
        for letters in ALPHABETS:
            out = F.when(F.instr(F.lit(letters), c) > 0, F.substring(F.lit(letters), F.pmod(n, F.lit(len(letters))).cast("int") + 1, 1)).otherwise(out)
        # characters of no alphabet stay at first; layout stays
        other = (out == c) & ~F.lit("".join(ALPHABETS)).contains(c) & ((kind == "secret") | (kind.startswith("name_") & c.rlike(r"\p{L}")) | ((kind == "email") & ~c.isin("@", ".")))
        out = F.when(wide & other, letter(i)).otherwise(out)
        out = F.when(hexes, F.substring(F.lit("0123456789abcdef"), F.pmod(n, F.lit(16)).cast("int") + 1, 1)).otherwise(out)
        # the end of each part of a name
        last = ~F.substring(entity, i + 2, F.lit(1)).rlike(r"\p{L}")
        fixed = (
            ((kind == "access_key") & (i < 4))
            | (kind.startswith("name_") & last)
            # country code and the exchange kept for fiction; the network of a card; the end of a mail domain
            | ((kind == "phone") & ~wide & ((i < F.length(entity) - 10) | ((F.substring(entity, -7, 3) == "555") & (i >= F.length(entity) - 7) & (i < F.length(entity) - 4))))
            | ((kind == "card") & (i == 0))
            | ((kind == "email") & (i >= F.length(entity) - F.length(F.substring_index(entity, ".", -1)) - 1))
        )
        return F.when(fixed, c).otherwise(out)

    plain = F.array_join(F.transform(places, place), "")
    # phone numbers have a second round of their length, without fixed digits
    extra = attempt - F.when(kind == "phone", 2 * PLAIN).otherwise(PLAIN)
    more = F.when(extra >= 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(extra, F.lit(0)) + ADDED), lambda j: letter(j + 1_000_000)), "")).otherwise("")
    body = F.concat(F.substring(plain, F.lit(1), F.length(plain) - 1), more)
    check = F.pmod(F.lit(10) - luhn_sum(body, 0) % 10, F.lit(10)).cast("string")

    def octet(k: int) -> Column:
        return F.pmod(drawn(secret, kind, entity, attempt, F.lit(k)), F.lit(256)).cast("string")

    # private addresses first; beyond a few draws any address
    lead = F.when(attempt < 4, F.lit("10")).otherwise((F.pmod(drawn(secret, kind, entity, attempt, F.lit(0)), F.lit(223)) + 1).cast("string"))
    ip = F.concat_ws(".", lead, octet(1), octet(2), octet(3), F.when(more != "", more))
    # the last letter of a name stays the last, the domain of an address its end
    name = F.concat(body, F.substring(plain, -1, 1))
    return F.when(kind == "ip", ip).when(kind == "card", F.concat(body, check)).when(kind.startswith("name_"), name).when(kind == "email", F.concat(more, plain)).otherwise(F.concat(plain, more))


def laid_out(kind: Column, mention: Column, new: Column) -> Column:
    """A surrogate in the layout and case of a mention; what it has beyond the mention's places follows."""
    places = F.filter(F.split(mention, ""), lambda c: c != "")

    def step(acc: Column, c: Column) -> Column:
        n = F.substring(new, acc["k"], F.lit(1))
        cased = F.when((F.lower(c) != c), F.upper(n)).otherwise(n)
        hit = F.when(kind.isin("phone", "card", "ssn"), c.rlike("[0-9]")).otherwise(F.lit(True))
        return F.struct(F.concat(acc["s"], F.when(hit, cased).otherwise(c)).alias("s"), (acc["k"] + F.when(hit, 1).otherwise(0)).cast("int").alias("k"))

    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("k"))

    def whole(a: Column) -> Column:
        return F.concat(a["s"], F.substring(new, a["k"], F.length(new)))

    walked = F.aggregate(places, start, step, whole)
    title = F.regexp_extract(mention, r"^(\S+\s)", 1)
    name = F.regexp_replace(mention, r"^\S+\s", "")
    named = F.aggregate(F.filter(F.split(name, ""), lambda c: c != ""), start, step, whole)
    same_case = F.when(kind.isin("secret", "access_key", "ip"), new)
    return F.coalesce(same_case, F.when(kind.startswith("name_"), F.concat(title, named)).otherwise(walked))


def dictionary(mentions: DataFrame, secret: str) -> DataFrame:
    """(kind, entity, new) with distinct surrogates that no text holds."""
    entities = written(mentions.select("kind", "entity").distinct())
    state = entities.withColumn("attempt", F.lit(0))
    real = entities.select("kind", F.col("entity").alias("new"), F.lit(True).alias("real"))
    while True:
        rows = written(state.withColumn("new", surrogate(secret, F.col("kind"), F.col("entity"), F.col("attempt"))))
        # of the entities that drew one surrogate the first one keeps it, unless it is an entity of the texts
        first = rows.groupBy("kind", "new").agg(F.min("entity").alias("first"), F.count("*").alias("n"))
        clash = first.join(real, ["kind", "new"], "left").where("n > 1 OR real").select("kind", "new", "first", F.coalesce("real", F.lit(False)).alias("real"))
        again = rows.join(clash, ["kind", "new"]).where(F.col("real") | (F.col("entity") != F.col("first"))).select("kind", "entity")
        if not again.limit(1).count():
            return rows.select("kind", "entity", "new")
        again = written(again).withColumn("_more", F.lit(1))
        state = rows.join(again, ["kind", "entity"], "left").select("kind", "entity", (F.col("attempt") + F.coalesce("_more", F.lit(0))).alias("attempt"))


def replace_entities(docs: DataFrame, secret: str) -> DataFrame:
    """``docs`` with ``n_entities`` (mentions replaced), ``kinds`` (kinds found, sorted) and ``replaced`` (the new text).

    A null text stays null and has no entities. Repeated rows are replaced alike. Input columns of the names added are
    replaced.
    """
    added = ("n_entities", "kinds", "replaced", "_key", "_hash", "_new")
    rows = docs.select(*[c for c in docs.columns if c not in added])
    some = F.coalesce(F.col("text").rlike(SOME), F.lit(False))
    none = rows.where(~some).select("*", F.lit(0).cast("long").alias("n_entities"), F.expr("cast(array() as array<string>)").alias("kinds"), F.col("text").alias("replaced"))
    key = (F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_key"), F.xxhash64("text").alias("_hash"))
    held = rows.where(some).select("*", *key)
    found = held.select("_key", "_hash", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))).alias("mention"))
    found = found.withColumn("kind", kind_of(F.col("mention"))).where("kind IS NOT NULL")
    found = written(found.withColumn("entity", canonical(F.col("kind"), F.col("mention"))))
    names = written(dictionary(found, secret))
    new = found.join(names, ["kind", "entity"]).select("_key", "_hash", "mention", "kind", laid_out(F.col("kind"), F.col("mention"), F.col("new")).alias("new"))
    new = new.groupBy("_key", "_hash").agg(F.map_from_entries(F.collect_set(F.struct("mention", "new"))).alias("_new"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    both = held.join(new, ["_key", "_hash"], "left")
    mentions = F.regexp_extract_all("text", F.lit(ANY), F.lit(0))
    gaps = F.split("text", ANY, -1)
    text = F.array_join(F.zip_with(gaps, mentions, lambda g, m: F.concat(g, F.coalesce(F.try_element_at("_new", m), m, F.lit("")))), "")
    count = F.size(F.filter(mentions, lambda m: F.array_contains(F.map_keys("_new"), m)))
    hit = F.col("_new").isNotNull()
    out = both.select(
        *rows.columns, F.when(hit, count).otherwise(0).cast("long").alias("n_entities"),
        F.coalesce("kinds", F.expr("cast(array() as array<string>)")).alias("kinds"), F.when(hit, text).otherwise(F.col("text")).alias("replaced"),
    )
    return none.unionByName(out)


@query()
def op8_pii_surrogates(spark, sf_dir):
    rows = replace_entities(documents(spark, sf_dir).select("doc_id", "text"), secret="tidemark")
    return rows.select("doc_id", "n_entities", "kinds", F.col("replaced").alias("text"))
