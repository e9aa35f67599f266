import random

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from tallyloom.functions.stems import ADJECTIVAL, DERIVED, LONG_STEM, stems
from tallyloom.operators import losses as L
from tallyloom.plans.stem_sql import stem_tables

# Examples printed with the published rules, a word and its stem each.
PUBLISHED = """caresses caress ponies poni ties tie cats cat feed feed agreed agre plastered plaster bled bled
motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss
fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc
digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam
predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal
sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr
hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust
defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog
communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat
rate rate cease ceas controll control roll roll died die spied spi skies sky dying die using use enjoying enjoy flying fli""".split()


def test_published_stems(spark):
    df = spark.createDataFrame([(PUBLISHED[::2],)], "w array<string>")
    assert df.select(stems(F.col("w"))).first()[0] == PUBLISHED[1::2]


def test_stems_of_made_words_equal_the_sql(spark):
    rng = random.Random(5)
    ends = [*DERIVED, *ADJECTIVAL, *LONG_STEM, "s", "es", "ies", "ied", "ed", "eed", "ing", "y", "ly", "ion", "logi", "e", "ll", "yy", ""]
    words = sorted({
        "".join(rng.choice("abeilostyyz1") for _ in range(rng.randint(0, 6))) + rng.choice(ends) + rng.choice(["", "", "s", "ed", "ing"])
        for _ in range(6000)
    } - {""})
    con = duckdb.connect()
    con.register("made", pd.DataFrame({"token": words}))
    expected = dict(con.execute(f"WITH {stem_tables('made')} SELECT token, stem FROM stems").fetchall())
    df = spark.createDataFrame([(words,)], "w array<string>")
    got = dict(zip(words, df.select(stems(F.col("w"))).first()[0]))
    # Both tell any run of up to six y apart.
    assert got == expected


def test_stems_of_nothing(spark):
    df = spark.createDataFrame([(None,), ([],), ([None, "cats", "as"],)], "w array<string>")
    assert [r[0] for r in df.select(stems(F.col("w"))).collect()] == [None, [], [None, "cat", "as"]]


def test_stemmed_overlap(spark):
    df = spark.createDataFrame(
        [(1, "The cats were running", "a cat runs"), (2, None, "a"), (3, "", ""), (4, "Cats", "cats")],
        "i int, predicted string, gold string",
    )
    grams = {r["i"]: r["f"] for r in L.gram_overlap(df, ["i"], 1, "f", stemmed=True).collect()}
    # Stems: the cat were run / a cat run
    assert grams == {1: 2 * 2 / 7, 2: 0.0, 3: 0.0, 4: 1.0}
    plain = {r["i"]: r["f"] for r in L.gram_overlap(df, ["i"], 1, "f").collect()}
    assert plain[1] == 0.0
    rows = {r["i"]: r["f"] for r in L.subsequence_overlap(df, ["i"], "f", stemmed=True).collect()}
    assert rows == {1: 2 * 2 / 7, 2: 0.0, 3: 0.0, 4: 1.0}


def test_long_subsequences_cross_groups_of_bits(spark):
    """Equal, reversed and shifted arrays far longer than one group of bits."""
    words = [f"w{i}" for i in range(500)]
    rows = [(1, words, words), (2, words, words[::-1]), (3, words[250:], words), (4, words, words[62:] + words[:62]), (5, words, None)]
    df = spark.createDataFrame(rows, "i int, p array<string>, g array<string>")
    got = {r["i"]: r["f"] for r in df.select("i", L.longest_common_f1(F.col("p"), F.col("g")).alias("f")).collect()}
    expected = {1: 1.0, 2: 2 / 1000, 3: 2 * 250 / 750, 4: 2 * 438 / 1000, 5: 0.0}
    assert all(abs(got[i] - expected[i]) < 1e-12 for i in expected)
