"""Text columns: cleaning, script filters, tokenisers and reading tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.grid import _c

# Patterns of the cleaning step per language.  The zh pattern only
# removes a character before "]" together with the bracket.
CLEAN_PATTERNS = {
    "zh": r"[^\[一-龥]\]",
    "en": r"""[^a-zA-Z0-9\s,.!?;:"'\-]""",
    "ja": None,
}
# Tokeniser patterns.
LETTERS = r"A-Za-z'\-’"
SMALL_KANA = "ャュョゃゅょァィゥェォぁぃぅぇぉ"
KANA = r"぀-ゟ゠-ヿ"
MIXED_TOKEN = rf"[{LETTERS}]+|[一-龥\p{{Nd}}]|[{KANA}][{SMALL_KANA}]?"
PLAIN_TOKEN = rf"[A-Za-z]+|[一-龥\p{{Nd}}]|[{KANA}][{SMALL_KANA}]?"
RUN_TOKEN = rf"[{LETTERS}]+|[\p{{Nd}}〇]+|[一-鿿{KANA}々〆〇]+"
MORA_TOKEN = rf"(?s)[{KANA}][{SMALL_KANA}]?ー?|."
# What the script filter removes, and the scripts it joins.
ASCII_WORD = r"[A-Za-z]+(?:['’\-][A-Za-z]+)*"
ASCII_MARKS = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]+"""
CJK = r"㐀-鿿぀-ヿㇰ-ㇿｦ-ﾟ"
# Tone letters and their plain letters.
TONE_LETTERS = "āáǎàōóǒòēéěèīíǐìūúǔùḿǹǖǘǚǜü"
PLAIN_LETTERS = "aaaaooooeeeeiiiiuuuumnvvvvv"
# Digits and numerals.
NUMERALS = "零一二三四五六七八九"
SPOKEN_DIGITS = {"零": "0", "一": "1", "幺": "1", "二": "2", "三": "3", "四": "4", "五": "5", "六": "6", "七": "7", "八": "8", "九": "9"}
# Katakana to romaji.
KANA_READINGS = {
    "ア": "a", "イ": "i", "ウ": "u", "エ": "e", "オ": "o",
    "カ": "ka", "キ": "ki", "ク": "ku", "ケ": "ke", "コ": "ko",
    "サ": "sa", "シ": "shi", "ス": "su", "セ": "se", "ソ": "so",
    "タ": "ta", "チ": "chi", "ツ": "tsu", "テ": "te", "ト": "to",
    "ナ": "na", "ニ": "ni", "ヌ": "nu", "ネ": "ne", "ノ": "no",
    "ハ": "ha", "ヒ": "hi", "フ": "fu", "ヘ": "he", "ホ": "ho",
    "マ": "ma", "ミ": "mi", "ム": "mu", "メ": "me", "モ": "mo",
    "ヤ": "ya", "ユ": "yu", "ヨ": "yo",
    "ラ": "ra", "リ": "ri", "ル": "ru", "レ": "re", "ロ": "ro",
    "ワ": "wa", "ヲ": "o", "ン": "n",
    "ガ": "ga", "ギ": "gi", "グ": "gu", "ゲ": "ge", "ゴ": "go",
    "ザ": "za", "ジ": "ji", "ズ": "zu", "ゼ": "ze", "ゾ": "zo",
    "ダ": "da", "ヂ": "ji", "ヅ": "zu", "デ": "de", "ド": "do",
    "バ": "ba", "ビ": "bi", "ブ": "bu", "ベ": "be", "ボ": "bo",
    "パ": "pa", "ピ": "pi", "プ": "pu", "ペ": "pe", "ポ": "po",
    "キャ": "kya", "キュ": "kyu", "キョ": "kyo",
    "シャ": "sha", "シュ": "shu", "ショ": "sho",
    "チャ": "cha", "チュ": "chu", "チョ": "cho",
    "ニャ": "nya", "ニュ": "nyu", "ニョ": "nyo",
    "ヒャ": "hya", "ヒュ": "hyu", "ヒョ": "hyo",
    "ミャ": "mya", "ミュ": "myu", "ミョ": "myo",
    "リャ": "rya", "リュ": "ryu", "リョ": "ryo",
    "ギャ": "gya", "ギュ": "gyu", "ギョ": "gyo",
    "ジャ": "ja", "ジュ": "ju", "ジョ": "jo",
    "ビャ": "bya", "ビュ": "byu", "ビョ": "byo",
    "ピャ": "pya", "ピュ": "pyu", "ピョ": "pyo",
    "ファ": "fa", "フィ": "fi", "フェ": "fe", "フォ": "fo",
    "ヴァ": "va", "ヴィ": "vi", "ヴ": "vu", "ヴェ": "ve", "ヴォ": "vo",
    "ティ": "ti", "ディ": "di", "トゥ": "tu", "ドゥ": "du",
    "チェ": "che", "ジェ": "je", "シェ": "she",
    "ウィ": "wi", "ウェ": "we", "ウォ": "wo",
    "クァ": "kwa", "グァ": "gwa",
    "ッ": "cl",
}
# Phone tokens.
VOWELS = {"a": "a", "i": "i", "u": "u", "e": "e", "o": "o", "I": "i", "U": "u"}
CONSONANTS = (
    "b", "by", "ch", "d", "dy", "f", "fy", "g", "gw", "gy", "h", "hy", "j", "k", "kw", "ky",
    "m", "my", "n", "ny", "p", "py", "r", "ry", "s", "sh", "t", "ts", "ty", "v", "w", "y", "z",
)
IRREGULAR_MORAE = {
    "si": "shi", "zi": "ji", "kyi": "ki", "gyi": "gi", "nyi": "ni", "hyi": "hi", "myi": "mi", "ryi": "ri",
    "byi": "bi", "pyi": "pi", "tyi": "chi", "tyu": "chu", "tyo": "cho", "dyi": "ji", "dyu": "ju", "dyo": "jo",
}
SILENCE_TOKENS = ("sil", "sp", "pau", "br")
DROPPED_TOKENS = ("<blank>", "pad", "<unk>", "unk")


def _lookup(table: Mapping[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), key)


def squeeze(text) -> Column:
    """Collapse whitespace runs and trim."""
    return F.trim(F.regexp_replace(_c(text), r"[\s\x1c-\x1f\u0085\p{Z}]+", " "))


def clean_text(text, language: str) -> Column:
    if language not in CLEAN_PATTERNS:
        raise ValueError(f"Unsupported language: {language}")
    pattern = CLEAN_PATTERNS[language]
    t = _c(text)
    return squeeze(t if pattern is None else F.regexp_replace(t, pattern, ""))


#: Languages written in Latin letters with marks: every letter stays, and the marks of the English rule.
LETTER_PATTERN = r"""[^\p{L}\p{M}\p{Nd}\s,.!?;:"'\-]"""


def clean_by_language(text, language) -> Column:
    """As ``clean_text`` with the language of each row; a language without a rule of its own keeps all letters."""
    lang = F.lower(F.trim(_c(language)))
    out = squeeze(F.regexp_replace(_c(text), LETTER_PATTERN, ""))
    for name in CLEAN_PATTERNS:
        out = F.when(lang == name, clean_text(text, name)).otherwise(out)
    return out


#: Tokens of languages without a rule of their own: runs of letters with their marks, and single digits.
LETTER_TOKEN = r"[\p{L}\p{M}'\-’]+|[\p{Nd}]"


def letter_tokens(text) -> Column:
    """Lower-case tokens of a text in any language written in letters."""
    cleaned = squeeze(F.regexp_replace(_c(text), LETTER_PATTERN, ""))
    return F.regexp_extract_all(F.lower(cleaned), F.lit(LETTER_TOKEN), F.lit(0))


def tokens_by_language(text, language) -> Column:
    """Tokens by the rule of each row's language; a language without a rule keeps all letters."""
    lang = F.lower(F.trim(_c(language)))
    out = letter_tokens(text)
    for name, tokens in PROCESSORS.items():
        out = F.when(lang == name, tokens(_c(text))).otherwise(out)
    return out


def script_filter(text, language) -> Column:
    """For zh and ja, drop ASCII words and marks and rejoin CJK across spaces."""
    from tidemark.functions.checks import language_code

    t = F.trim(F.coalesce(_c(text), F.lit("")))
    bare = F.regexp_replace(F.regexp_replace(t, ASCII_WORD, " "), ASCII_MARKS, " ")
    joined = F.regexp_replace(squeeze(bare), rf"(?<=[{CJK}])\s+(?=[{CJK}])", "")
    return F.when(language_code(language).isin("zh", "ja"), joined).otherwise(t)


def mixed_tokens(text) -> Column:
    """Letter runs with apostrophe and hyphen, single Han characters and digits, kana."""
    return F.regexp_extract_all(_c(text), F.lit(MIXED_TOKEN), F.lit(0))


def plain_tokens(text) -> Column:
    """As ``mixed_tokens`` but letter runs are letters only."""
    return F.regexp_extract_all(_c(text), F.lit(PLAIN_TOKEN), F.lit(0))


def run_tokens(text) -> Column:
    """Runs of letters, of numerals and of Japanese characters."""
    return F.regexp_extract_all(_c(text), F.lit(RUN_TOKEN), F.lit(0))


def kana_tokens(text) -> Column:
    """Kana with a small kana and a long mark attached; other characters alone."""
    return F.regexp_extract_all(_c(text), F.lit(MORA_TOKEN), F.lit(0))


def to_hiragana(text) -> Column:
    source = "".join(chr(c) for c in range(0x30A1, 0x30F7))
    return F.translate(_c(text), source, "".join(chr(ord(c) - 0x60) for c in source))


def to_katakana(text) -> Column:
    source = "".join(chr(c) for c in range(0x3041, 0x3097))
    return F.translate(_c(text), source, "".join(chr(ord(c) + 0x60) for c in source))


def fold_tones(text) -> Column:
    """Tone letters to plain letters."""
    return F.translate(_c(text), TONE_LETTERS, PLAIN_LETTERS)


def digits_to_numerals(text) -> Column:
    wide = "".join(chr(0xFF10 + i) for i in range(10))
    return F.translate(_c(text), "0123456789" + wide + "〇", NUMERALS * 2 + "零")


def drop_tone_number(text) -> Column:
    return F.regexp_replace(_c(text), r"\p{Nd}$", "")


def kana_morae(text) -> Column:
    """Romaji morae of a kana string; a long mark repeats the vowel before it."""
    pairs = [k for k in KANA_READINGS if len(k) == 2]
    kana = F.regexp_replace(to_katakana(F.regexp_replace(_c(text), "’", "")), r"[^\p{L}ー]", "")
    pieces = F.regexp_extract_all(kana, F.lit(rf"(?:{'|'.join(pairs)}|[^ー])ー*"), F.lit(0))

    def expand(piece):
        head = F.regexp_replace(piece, "ー+$", "")
        mora = F.coalesce(_lookup(KANA_READINGS, head), F.lower(head))
        longer = F.when(mora.isin("cl", "n"), 0).otherwise(F.length(piece) - F.length(head))
        return F.concat(F.array(mora), F.array_repeat(F.substring(mora, -1, 1), longer))

    return F.flatten(F.transform(pieces, expand))


def phone_token(token) -> Column:
    """Canonical phone token; empty for padding."""
    t = F.trim(F.coalesce(_c(token), F.lit("")))
    low = F.lower(t)
    return (
        F.when(low.isin(*SILENCE_TOKENS), "SP")
        .when(low.isin("ap", "ep"), F.upper(low))
        .when(low.isin(*DROPPED_TOKENS), "")
        .otherwise(t)
    )


def phones_to_morae(tokens) -> Column:
    """Join each consonant with the vowel after it; drop silence tokens."""
    t = _c(tokens)
    vowels = list(VOWELS)

    def mora(x, i):
        following = F.coalesce(F.get(t, i + 1), F.lit(""))
        before = F.when(i > 0, F.coalesce(F.get(t, i - 1), F.lit(""))).otherwise(F.lit(""))
        joined = F.concat(x, _lookup(VOWELS, following))
        return (
            F.when(x == "SP", F.lit(None).cast("string"))
            .when(x.isin("AP", "EP"), x)
            .when(x == "N", F.lit("n"))
            .when(x.isin(*vowels) & before.isin(*CONSONANTS), F.lit(None).cast("string"))
            .when(x.isin(*vowels), _lookup(VOWELS, x))
            .when(x.isin(*CONSONANTS) & following.isin(*vowels), F.coalesce(_lookup(IRREGULAR_MORAE, joined), joined))
            .otherwise(F.lower(x))
        )

    return F.array_compact(F.transform(t, mora))


def mora_phones(token) -> Column:
    """Phones of one mora token, e.g. ``kya -> [ky, a]``."""
    t = _c(token)
    low = F.lower(t)
    onsets = "|".join(sorted(CONSONANTS, key=lambda c: (-len(c), c)))
    shape = rf"^({onsets})([aiueo]*)$"
    onset = F.regexp_extract(low, shape, 1)
    rest = F.split(F.regexp_extract(low, shape, 2), "")
    tail = F.filter(rest, lambda c: c != "")
    glide = rf"^({onsets})y([aiueo])$"
    return (
        F.when(t == "N", F.array(F.lit("N")))
        .when(t == "cl", F.array(F.lit("cl")))
        .when(low.isin("a", "i", "u", "e", "o"), F.array(low))
        .when(low == "n", F.array(F.lit("N")))
        .when(onset == "fy", F.concat(F.array(F.lit("f"), F.lit("y")), tail))
        .when(onset != "", F.concat(F.array(onset), tail))
        .when(
            low.rlike(glide),
            F.array(F.regexp_extract(low, glide, 1), F.lit("y"), F.regexp_extract(low, glide, 2)),
        )
        .otherwise(F.array(t))
    )


def mora_word(token) -> Column:
    """Display form of a mora token."""
    t = _c(token)
    return F.when(t == "N", "n").when(t == "cl", "cl").otherwise(F.lower(t))


def mora_words(tokens) -> Column:
    """Array of ``struct(word, phones)`` of a phone token array, silence left out."""
    kept = F.filter(_c(tokens), lambda x: (x != "") & ~x.isin("SP", "AP", "EP"))
    return F.transform(kept, lambda x: F.struct(mora_word(x).alias("word"), mora_phones(x).alias("phones")))


def weave(words, prefix: str | None = None, separator: str = "SP") -> Column:
    """``struct(label, word)`` array: phones of ``words`` with separators between.

    ``words`` is an array of ``struct(word, phones)``.  The sequence starts and
    ends with a separator and never holds two in a row; a separator has word
    index -1.
    """
    w = _c(words)
    gap = F.struct(F.lit(separator).alias("label"), F.lit(-1).alias("word"))

    def label(p):
        return F.when(p == separator, p).otherwise(F.concat(F.lit(f"{prefix}/"), p)) if prefix else p

    def phones(x, i):
        p = x.getField("phones")
        n = F.size(p)
        inner = F.filter(p, lambda v, k: ~((v == separator) & ((k == 0) | (k == n - 1))))
        own = F.transform(inner, lambda v: F.struct(label(v).alias("label"), i.cast("int").alias("word")))
        return F.when(F.size(own) > 0, F.concat(own, F.array(gap))).otherwise(own)

    return F.concat(F.array(gap), F.flatten(F.transform(w, phones)))


def phone_words(text, separator: str = "SP") -> Column:
    """Words of a space separated phone string, one phone per word."""
    kept = F.filter(F.split(F.trim(_c(text)), " "), lambda x: x != separator)
    return F.transform(kept, lambda x: F.struct(x.alias("word"), F.array(x).alias("phones")))


def strip_prefix(label) -> Column:
    """``lang/x -> x``."""
    return F.element_at(F.split(_c(label), "/"), -1)


def stem(path) -> Column:
    """File name without folder and last extension."""
    return F.regexp_replace(F.element_at(F.split(_c(path), "/"), -1), r"(?<=.)\.[^.]*$", "")


def group_key(name) -> Column:
    """Name up to its last underscore."""
    return F.regexp_replace(_c(name), r"_[^_]*$", "")


def display(text_tokens, sound_tokens, language, mode) -> Column:
    """Tokens to show: sounds for pinyin and romaji, text otherwise."""
    return F.when(_c(mode).isin("pinyin", "romaji"), _c(sound_tokens)).otherwise(_c(text_tokens))


def join_display(tokens, mode) -> Column:
    return F.when(_c(mode).isin("pinyin", "romaji"), F.array_join(_c(tokens), " ")).otherwise(
        F.array_join(_c(tokens), "")
    )


# Spoken digit runs and the parts of a spoken date.
DIGIT_RUN = r"[零幺一二三四五六七八九]{2,}"
SPOKEN_YEAR = r"[零一二三四五六七八九]{2,4}(?=年)"
SPOKEN_SMALL = r"[一二三四五六七八九]?十?[一二三四五六七八九]?"


def _small_number(n: Column) -> Column:
    """Spoken number below 100."""
    tens = F.regexp_extract(n, r"^([一二三四五六七八九]?)十", 1)
    ones = F.regexp_extract(n, r"([一二三四五六七八九]?)$", 1)
    digit = F.create_map(*[F.lit(v) for kv in SPOKEN_DIGITS.items() for v in kv])
    ten = F.when(n.contains("十"), F.coalesce(F.element_at(digit, tens).cast("int"), F.lit(1)) * 10).otherwise(0)
    return (ten + F.coalesce(F.element_at(digit, ones).cast("int"), F.lit(0))).cast("string")


def rewrite_spoken_digits(text) -> Column:
    """Digit runs and year, month and day numbers of a text as Arabic digits.

    The text is cut at the numbers that stand before a month or day sign; these
    are read as numbers below 100, all other digit runs digit by digit.
    """
    t = _c(text)
    cut = r"((?:[一二三四五六七八九]?十[一二三四五六七八九]?|(?<![零幺一二三四五六七八九])[一二三四五六七八九])(?=[月日号]))"
    marked = F.split(F.regexp_replace(t, cut, "\u0001$1\u0002"), "\u0001")
    source, target = "".join(SPOKEN_DIGITS), "".join(SPOKEN_DIGITS.values())

    def digit_runs(s):
        # a run keeps its place while single numerals stay as they are
        parts = F.split(F.regexp_replace(s, rf"({DIGIT_RUN})", "\u0003$1\u0004"), "\u0003")
        fixed = F.transform(
            parts,
            lambda p: F.when(
                p.contains("\u0004"),
                F.concat(
                    F.translate(F.substring_index(p, "\u0004", 1), source, target), F.substring_index(p, "\u0004", -1)
                ),
            ).otherwise(p),
        )
        return F.array_join(fixed, "")

    def piece(p):
        return F.when(
            p.contains("\u0002"),
            F.concat(_small_number(F.substring_index(p, "\u0002", 1)), digit_runs(F.substring_index(p, "\u0002", -1))),
        ).otherwise(digit_runs(p))

    return F.array_join(F.transform(marked, piece), "")


def spoken_digit_counts(text) -> Column:
    """Number of digit runs, years and month or day numbers in a text."""
    t = _c(text)

    def count(pattern):
        return F.size(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)))

    return F.struct(
        count(DIGIT_RUN).alias("digit_runs"),
        count(SPOKEN_YEAR).alias("years"),
        count(r"(?:[一二三四五六七八九]?十[一二三四五六七八九]?|[一二三四五六七八九])(?=[月日号])").alias("month_days"),
    )


# Language registry: builders of the cleaned text and its tokens.
PROCESSORS: dict[str, Callable[[Column], Column]] = {
    "zh": lambda t: mixed_tokens(clean_text(t, "zh")),
    "en": lambda t: mixed_tokens(F.lower(clean_text(t, "en"))),
    "ja": lambda t: kana_tokens(to_hiragana(clean_text(t, "ja"))),
}


def tokens_for(language: str) -> Callable[[Column], Column]:
    """Tokeniser of a language; an unknown language is an error."""
    try:
        return PROCESSORS[language.lower()]
    except KeyError:
        raise ValueError(f"Unsupported language: {language}") from None
