import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftlink.functions import similarity as S
from weftlink.functions import text as T


@pytest.fixture
def one(spark):
    def value(expression, **columns):
        return spark.range(1).select(*(F.lit(v).alias(k) for k, v in columns.items())).select(expression.alias("x")).first()["x"]

    return value


def test_french_golden_values(one):
    assert one(T.french_name(F.lit("Société d’Ingénierie & L’Étoile S.A.R.L."))) == "societe d ingenierie l etoile sarl"
    a = one(T.french_address(F.lit("18, Avenue de la République, Bât B, 75011 Paris, Cedex 11")))
    assert (a["postal"], a["department"]) == ("75011", "75") and "avenue" in a["address"]
    assert one(T.french_address(F.lit(None).cast("string")))["address"] == "none"
    assert one(T.french_name(F.lit("Dupont S.A.S.U"))) == "dupont sasu"


def test_names_and_keys(one):
    assert one(T.canonical_name(F.lit("Acme Corp."))) == "acme corporation"
    assert one(T.name_key(F.lit("Acme Corporation"))) == "acmecorp"
    assert one(T.name_key(F.lit("Widget Private  Limited"))) == "widgetpvtltd"
    assert one(T.canonical_name(F.lit("Foo Pvt. Ltd"))) == "foo private limited"
    assert one(T.clean_text(F.lit(None).cast("string"))) == ""
    assert one(T.clean_text(F.lit("l'étoile éltd"))) == "l etoile eltd"


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=30))
def test_bare_texts_in_any_script(text):
    pass_through = T._bare(text)
    assert not any(__import__("unicodedata").combining(c) for c in pass_through)


def test_native_and_python_stripping_agree(spark):
    texts = ["société", "ﬁn", "½ Ünï", "नमस्ते", "ａｂｃ", "한국어", "x́y", None, "", "Ⅷ", "plain"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in rows.select("t", T.strip_marks(F.col("t"), native=False).alias("s"), T.clean_text(F.col("t"), native=False).alias("c")).collect():
        assert r["s"] == (None if r["t"] is None else T._bare(r["t"]))
        assert r["c"] == T.spec_clean(r["t"])
    latin = spark.createDataFrame([("Çà et là",), ("Straße",), ("Ñandú",)], "t string")
    assert all(r["a"] == T._bare(r["t"]) for r in latin.select("t", T.strip_marks(F.col("t")).alias("a")).collect())


def test_small_pieces(one):
    assert one(T.postal_code(F.lit("a 1234 b 560001 c"))) == "560001" and one(T.postal_code(F.lit("1234567"))) is None
    assert one(T.phonetic_prefix(F.lit("a1b"))) == "abxx"
    assert one(T.salient_tokens(F.lit("acme tools acme more"), 3)) == ["acme", "tools", "acme"]
    assert one(T.char_ngrams(F.lit("ab"))) == [] and one(T.char_ngrams(F.lit("abcab"))) == ["abc", "bca", "cab"]
    assert one(T.sorted_tokens(F.lit("b a b"))) == "a b"
    assert one(T.list_items(F.lit(" a, ,b"))) == ["a", "b"] and one(T.list_size(F.lit("a,,b"))) == 3 and one(T.list_size(F.lit(" "))) == 0
    assert one(T.digit_count(F.lit("a1b22"))) == 3 and one(T.word_count(F.lit("  "))) == 0 and one(T.word_count(F.lit(" a  b"))) == 2
    assert one(T.source_of(F.lit("S2-7"))) == "S2"


def test_similarity_values(one):
    lit = F.lit
    assert one(S.levenshtein_ratio(lit(""), lit(""))) == 1.0 and one(S.levenshtein_ratio(lit("a"), lit(""))) == 0.0
    assert one(S.ngram_jaccard(lit("ab"), lit("ab"))) == 1.0 and one(S.ngram_jaccard(lit("ab"), lit("abc"))) == 0.0
    assert one(S.token_jaccard(lit(""), lit("a"))) == 0.0 and one(S.token_jaccard(lit("a b"), lit("b c"))) == pytest.approx(1 / 3)
    assert one(S.token_sort_ratio(lit("b a"), lit("a b b"))) == 1.0
    assert one(S.common_prefix(lit("abcd"), lit("abxd"))) == 2 and one(S.common_prefix(lit(""), lit("a"))) == 0


def test_jaro_winkler_values(spark):
    cases = {("", ""): 1.0, ("a", "b"): 0.0, ("abcd", "abxyzw"): 0.6888888888888889, ("xabcyyyy", "xbcayyyy"): 0.94375, ("", "a"): 0.0}
    for (a, b), want in cases.items():
        assert S.jaro_winkler_of(a, b) == pytest.approx(want)
    rows = spark.createDataFrame([(a, b) for a, b in cases] + [(None, "a")], "a string, b string")
    got = {(r["a"], r["b"]): r["s"] for r in rows.select("a", "b", S.jaro_winkler(F.col("a"), F.col("b")).alias("s")).collect()}
    assert got.pop((None, "a")) is None
    assert all(got[k] == pytest.approx(v) for k, v in cases.items())


@settings(max_examples=200, deadline=None)
@given(st.text("abcd", max_size=8), st.text("abcd", max_size=8))
def test_jaro_winkler_bounds(a, b):
    assert 0 <= S.jaro_winkler_of(a, b) <= 1 + 1e-12
    assert (S.jaro_winkler_of(a, b) == 1.0) == (a == b)


def test_optional_similarities(spark, one):
    lit = F.lit
    assert one(S.common_suffix(lit("abxcd"), lit("zcd"))) == 2
    assert one(S.word_ngram_jaccard(lit("a b c"), lit("a b d"))) == pytest.approx(1 / 3) and one(S.word_ngram_jaccard(lit("a"), lit("a b"))) == 0.0
    assert one(S.token_set_ratio(lit("acme tools"), lit("tools acme gmbh"))) == 1.0
    assert one(S.token_set_ratio(lit("ab"), lit("cd"))) == 0.0
    assert (S.damerau_of("abcd", "acbd"), S.damerau_of("", "ab"), S.damerau_of("ca", "abc")) == (1, 2, 3)
    assert S.monge_elkan_of("acme tools", "tools of acme") == 1.0 and S.monge_elkan_of("", "") == 1.0 and S.monge_elkan_of("a", "") == 0.0
    rows = spark.createDataFrame([("abcd", "acbd"), (None, "a")], "a string, b string")
    assert sorted(str(r[0]) for r in rows.select(S.damerau(F.col("a"), F.col("b"))).collect()) == ["1", "None"]
    assert rows.select(S.monge_elkan(F.col("a"), F.col("b"))).count() == 2
    assert one(S.directions_differ(lit("acme north"), lit("acme south"))) and not one(S.directions_differ(lit("acme north"), lit("acme")))
    assert one(S.must_stay_apart(lit("acme"), lit("zorblax"), lit("x 1"), lit("x 1"))) and not one(S.must_stay_apart(lit("acme"), lit("acme"), lit("x 1"), lit("x 1")))
