import pytest
from pyspark.sql import functions as F

from tidemark.functions import checks as C
from tidemark.functions import text as T


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("x")])
    return row.select(column.alias("r")).collect()[0].r


@pytest.mark.parametrize(
    "language,text,want",
    [
        ("en", "Hi—there,  you!\n(ok)", "Hithere, you! ok"),
        ("zh", "中 A 文3！", "中 A 文3！"),
        ("zh", "a]b[c^d-e\\f中  文", "b[c^d-e\\f中 文"),
        ("ja", " きょう \n は ", "きょう は"),
    ],
)
def test_clean(spark, language, text, want):
    assert one(spark, T.clean_text("t", language), t=text) == want


def test_unknown_language():
    with pytest.raises(ValueError):
        T.tokens_for("ko")


def test_tokenisers(spark):
    assert one(spark, T.mixed_tokens("t"), t="Don't 我3! きゃリa-b") == ["Don't", "我", "3", "きゃ", "リ", "a-b"]
    assert one(spark, T.plain_tokens("t"), t="Don't") == ["Don", "t"]
    assert one(spark, T.run_tokens("t"), t="ab'c 12〇 きょう天気!〇") == ["ab'c", "12〇", "きょう天気", "〇"]
    assert one(spark, T.kana_tokens("t"), t="きゃーらー天") == ["きゃー", "らー", "天"]


def test_script_filter(spark):
    assert one(spark, T.script_filter("t", F.lit("Chinese")), t="hello 我 们, don't 好") == "我们好"
    assert one(spark, T.script_filter("t", F.lit("en")), t=" hello 我 ") == "hello 我"


def test_readings(spark):
    assert one(spark, T.kana_morae("t"), t="キャー") == ["kya", "a"]
    assert one(spark, T.kana_morae("t"), t="ーンー、カーーッ") == ["n", "ka", "a", "a", "cl"]
    assert one(spark, T.kana_morae("t"), t="きょうx") == ["kyo", "u", "x"]
    assert one(spark, T.to_hiragana("t"), t="カタ") == "かた"
    assert one(spark, T.to_katakana("t"), t="かた") == "カタ"
    assert one(spark, T.fold_tones("t"), t="zhōng lǜ ü") == "zhong lv v"
    assert one(spark, T.digits_to_numerals("t"), t="1０〇") == "一零零"


def test_phones(spark):
    tokens = F.split(F.lit("SP k a N cl sh i I b q o SP ny i AP t"), " ")
    assert one(spark, T.phones_to_morae(tokens)) == ["ka", "n", "cl", "shi", "i", "b", "q", "o", "ni", "AP", "t"]
    assert one(spark, T.phone_token("t"), t=" Sil ") == "SP"
    assert one(spark, T.phone_token("t"), t="<blank>") == ""
    for token, want in [("kya", ["ky", "a"]), ("fyu", ["f", "y", "u"]), ("n", ["N"]), ("tsya", ["ts", "y", "a"]), ("hu", ["h", "u"]), ("I", ["i"]), ("q", ["q"]), ("k", ["k"])]:
        assert one(spark, T.mora_phones("t"), t=token) == want, token


def test_weave(spark):
    words = T.mora_words(F.split(F.lit("SP ka N"), " "))
    got = one(spark, T.weave(words, prefix="ja"))
    assert [(x.label, x.word) for x in got] == [("SP", -1), ("ja/k", 0), ("ja/a", 0), ("SP", -1), ("ja/N", 1), ("SP", -1)]
    assert [x.label for x in one(spark, T.weave(T.phone_words(F.lit("a SP b"))))] == ["SP", "a", "SP", "b", "SP"]


def test_spoken_digits(spark):
    for text, want in [
        ("一二三", "123"),
        ("一", "一"),
        ("二零二五年十月", "2025年10月"),
        ("今天是二零二五年十月三日", "今天是2025年10月3日"),
        ("二十一日一号", "21日1号"),
    ]:
        assert one(spark, T.rewrite_spoken_digits("t"), t=text) == want


def test_names(spark):
    assert one(spark, T.stem("t"), t="/a/b.c/song_01.tar.gz") == "song_01.tar"
    assert one(spark, T.group_key("t"), t="song_a_01") == "song_a"
    assert one(spark, T.strip_prefix("t"), t="ja/k") == "k"
    assert one(spark, C.mask_credentials("t"), t="http://u:p@q@host:1/x") == "http://***@host:1/x"
    assert one(spark, C.mask_credentials("t"), t="host:1") == "host:1"


def test_checks(spark):
    assert one(spark, C.method_name("t"), t=" Smart mode") == "smart"
    assert one(spark, C.method_name("t"), t="网格搜索切片") == "grid"
    garbled = "智能切片".encode().decode("gb18030", errors="ignore")
    assert one(spark, C.method_name("t"), t=garbled) == "smart"
    assert one(spark, C.method_name("t"), t="other") is None
    assert one(spark, C.output_mode("l", "m"), l="ja", m="hanzi") == "romaji"
    assert one(spark, C.output_mode("l", "m"), l="zh", m="拼音") == "pinyin"
    assert one(spark, C.log_level("t"), t="Already failed") == "success"
    assert one(spark, C.log_percent("t"), t="at 300%x") == 100
    assert one(spark, C.bounds_error(F.lit(5.0), F.lit(3.0))).startswith("slice_min_sec must be less")
    assert one(spark, C.bounds_error(F.lit(0.0), F.lit(0.0))) == "slice_max_sec must be greater than 0 seconds"
    assert one(spark, C.bounds_error(F.lit(5.0), F.lit(10.0))) is None
    with pytest.raises(ValueError):
        C.check_bounds(3, None)
    assert C.check_bounds(None, None) is None
    assert one(spark, C.is_nucleus(F.lit("zh/ang"), F.lit("zh"))) is True
    assert one(spark, C.is_nucleus(F.lit("ng"), F.lit("zh"))) is False
    assert one(spark, C.is_nucleus(F.lit("ja/N"), F.lit("ja"))) is True
    assert one(spark, C.language_name(F.lit(" eNGLISH "))) == "English"
