import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import text as X


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_words_and_tokens_differ_in_the_order_of_normalisation(spark):
    assert one(spark, X.words(F.col("t"), normalised=False), t="㏎ Ａ") == ["KM", "a"]
    assert one(spark, X.lexical_tokens(F.col("t"), normalised=False), t="㏎ Ａ") == ["km", "a"]


@pytest.mark.parametrize(("word", "stem"), [("news", "news"), ("cities", "city"), ("ties", "tie"), ("boxes", "box"), ("classes", "class"), ("miles", "mile"), ("gas", "gas"), ("cats", "cat"), ("bus", "bus"), ("glass", "glass"), ("analysis", "analysis"), ("species", "species"), ("is", "is")])
def test_stem(spark, word, stem):
    assert one(spark, X.stem(F.col("t")), t=word) == stem


def test_question(spark):
    for text, expected in [("Who founded it?", True), ("  what is", True), ("Whichford village", False), ("the who", False), ("isé x", True)]:
        assert one(spark, X.is_question(F.col("t")), t=text) == expected


@pytest.mark.parametrize(("text", "many", "twenty"), [("20", True, False), ("6", True, True), ("36", True, True), ("20 miles", False, False), ("20%", False, False), ("$20", False, False), ("1,234.5", True, True), ("-20", True, True)])
def test_standalone_numbers(spark, text, many, twenty):
    excluded = X.standalone_number(F.col("q"), F.col("t"))
    assert one(spark, excluded, q="How many miles?", t=text) == many
    assert one(spark, excluded, q="20", t=text) == twenty


def test_collapse_covers_web_white_space(spark):
    assert one(spark, X.collapse(F.col("t")), t="  a   b\n c ") == "a b c "


def test_simple_sentences(spark):
    assert one(spark, X.sentences(F.col("t")), t='One. Two! "Three?" four.5 five') == ["One.", "Two!", '"Three?"', "four.5 five"]


def test_unicode_sentences():
    found = [t for t, _, _ in X.split_sentences("It costs 3.5 euros. He said e.g. nothing. Done! Yes? \n New line")]
    assert found == ["It costs 3.5 euros.", "He said e.g. nothing.", "Done!", "Yes?", "New line"]


@given(st.text(alphabet="ab .!?\nA1", max_size=60))
def test_sentences_keep_offsets(text):
    last = 0
    for sentence, a, b in X.split_sentences(text):
        assert text[a:b] == sentence == sentence.strip() and a >= last
        last = b
    assert "".join(t for t, _, _ in X.split_sentences(text)).replace(" ", "").replace("\n", "") == "".join(text.split())


def test_phrase(spark):
    phrase = lambda t, p: one(spark, X.contains_phrase(F.split("t", " "), F.split("p", " ")), t=t, p=p)
    assert phrase("a b c", "b c") and not phrase("b a c", "b c") and not phrase("a", "a b")
    assert not one(spark, X.contains_phrase(F.split("t", " "), F.array().cast("array<string>")), t="a")


def test_roles(spark):
    role = lambda t, kind="sentence", r=False, n=False, c=False: one(spark, X.role(F.col("t"), F.lit(kind), F.lit(r), F.lit(n), F.lit(c)), t=t)
    assert role("one two three four") == "body" and role("one two 3 4") == "fragment"
    assert role("x", "heading") == "body" and role("x", "heading", n=True) == "navigation" and role("x", r=True, n=True) == "reference" and role("one two three four", c=True) == "control"


def test_token_offsets():
    text = "Café unboxing, hello!"
    spans = X.token_offsets(text, ["cafe", "un", "##box", "##ing", ",", "hello", "!"])
    assert [text[a:b] for a, b in spans] == ["Café", "un", "box", "ing", ",", "hello", "!"]
    text = "Hello 🦊 world"
    units = text.encode("utf-16-le")
    assert [units[2 * a : 2 * b].decode("utf-16-le") for a, b in X.token_offsets(text, ["hello", "[UNK]", "world"])] == ["Hello", "🦊", "world"]
    assert X.token_offsets("abc", ["zzz"]) == [(0, 3)]


def test_preview(spark):
    text = "x" * 100 + "y" * 300
    assert one(spark, X.preview(F.col("t"), F.lit(100), F.lit(110)), t=text) == "…" + text[52:292]
    assert one(spark, X.preview(F.col("t"), F.lit(10), F.lit(390)), t=text) == text[:390]


@given(st.text(alphabet="aé ̈🦊🦊B", max_size=12))
def test_offsets_stay_within_the_text(text):
    units = len(text.encode("utf-16-le")) // 2
    assert all(0 <= a <= units and 0 <= b <= units for a, b in X.token_offsets(text, ["[UNK]", "a", "##e", "[UNK]", "b"]))


def test_marks_belong_to_the_character_before(spark):
    assert X.token_offsets("e\u0301x", ["e", "x"]) == [(0, 2), (2, 3)]
    assert X.token_offsets("ab cd", ["[UNK]"]) == [(0, 5)] and X.token_offsets("", ["[UNK]"]) == [(0, 0)]


def test_functions_in_sql(spark):
    from lodestone.operators import windows

    X.register(spark)
    windows.register(spark)
    row = spark.sql("SELECT words('A b-C') AS w, lexical_tokens('Cities and miles') AS t, is_question('who?') AS q, nfkc('Ａ') AS n").first()
    assert (row["w"], row["t"], row["q"], row["n"]) == (["a", "b", "c"], ["city", "and", "mile"], True, "A")
    found = spark.sql("SELECT * FROM token_windows(array(1, 2, 3, 4, 5), 3, 1)").collect()
    assert [(r["start"], r["end"]) for r in found] == [(0, 3), (2, 5)]
    assert len(spark.range(1).select(windows.session_id().alias("x")).first()["x"]) == 32
