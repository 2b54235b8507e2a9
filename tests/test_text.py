import random

from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.functions import vectors as vx

ALPHABET = ["a", "b", " ", "\t", "\n", "\r", "\r\n", "\x0b", "\f", "\x1c", "\x85", "\xa0", " ", "　", "é", "😀", "v", "f", "\\"]


def _texts(n=400, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(0, 14))) for _ in range(n)] + ["", " ", "\n"]


def _column(spark, texts, make):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, s string")
    return [r[1] for r in df.select("i", make(F.col("s"))).orderBy("i").collect()]


def _normal(s):
    lines = s.strip().replace("\r\n", "\n").replace("\r", "\n").split("\n")
    return "\n".join(line.rstrip() for line in lines).strip()


def test_strip_and_normalize_match_python(spark):
    texts = _texts()
    assert _column(spark, texts, tx.strip) == [t.strip() for t in texts]
    assert _column(spark, texts, tx.normalize) == [_normal(t) for t in texts]
    assert _column(spark, texts, tx.has_text) == [bool(t.strip()) for t in texts]


def test_pieces(spark):
    texts = ["", "  ", "abc", "x" * 10, "é😀\n" * 9, " lead", "y" * 21]
    want = [[t.strip()[i : i + 5] for i in range(0, len(t.strip()), 5)] for t in texts]
    assert _column(spark, texts, lambda c: tx.pieces(c, 5)) == want
    kept = _column(spark, texts, lambda c: tx.pieces(c, 5, keep_empty=True))
    assert kept == [w or [""] for w in want]


def test_preview(spark):
    texts = ["a\nb", "x" * 10, "y" * 11]
    assert _column(spark, texts, lambda c: tx.preview(c, 10)) == ["a b", "x" * 10, "y" * 9 + "…"]


def test_row_names(spark):
    names = ["info::docs::row::7", "info::other::row::7", "info::docs::row::", "info::docs::row::7x", "a:b::docs::row::1", "x"]
    found = _column(spark, names, lambda c: tx.row_index(c, F.lit("docs")))
    assert found == [7, None, None, None, None, None]


def test_csv_cell_and_ints(spark):
    assert _column(spark, ['a"b', "a,b", "a\nb", "plain", None], tx.csv_cell) == ['"a""b"', '"a,b"', '"a\nb"', "plain", ""]
    assert _column(spark, ["12", " 7 ", "x", "", None, "1.5"], tx.to_int) == [12, 7, None, None, None, None]


def test_clean_sql(spark):
    replies = {
        "```sql\nSELECT a::int FROM t;\n```": "SELECT a::int FROM t;",
        "  SQL: SELECT 1 ": "SELECT 1",
        "sql\nSELECT 1": "SELECT 1",
        "`SELECT 1`": "SELECT 1",
        "SELECT `a`": "SELECT `a`",
        "SELECT 1\n```": "SELECT 1",
        "sqlite_master": "sqlite_master",
    }
    assert _column(spark, list(replies), tx.clean_sql) == list(replies.values())


def test_first_select(spark):
    replies = ["select 1; drop table t", " SELECT 2", "DROP TABLE t", "", "; select 1"]
    assert _column(spark, replies, tx.first_select) == ["select 1;", "SELECT 2;", "SELECT 1;", "SELECT 1;", "SELECT 1;"]


def test_split_list(spark):
    assert _column(spark, ["a, b,,c ", ""], tx.split_list) == [["a", "b", "c"], []]


def test_vector_text(spark):
    df = spark.createDataFrame([([0.5, -1.0, 1e-9],)], "v array<float>")
    assert df.select(vx.vector_text(F.col("v"))).first()[0] == "[0.50000000,-1.00000000,0.00000000]"


def test_pair_distances(spark):
    df = spark.createDataFrame([([3.0, 0.0], [0.0, 4.0])], "a array<float>, b array<float>")
    row = df.select(vx.l2_distance(F.col("a"), F.col("b")), vx.cosine_distance(F.col("a"), F.col("b"))).first()
    assert tuple(row) == (5.0, 1.0)


def test_hash_embedding_has_unit_length_and_ignores_case(spark):
    df = spark.createDataFrame([("Some words and some more",), ("SOME words and\nsome  more ",), ("",)], "s string")
    one, two, none = [r[0] for r in df.select(vx.hash_embedding(F.col("s"))).collect()]
    assert one == two and len(one) == vx.DIMS
    assert abs(sum(x * x for x in one) - 1) < 0.01
    assert set(none) == {0.0}
