"""Operators that SQL expresses, against DuckDB on small tables with nulls, ties and repeats."""

import duckdb
import pytest

from convolake.llm import mixing, quality_rules


def run(sql, rows):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint, size varchar, key double, n bigint)")
    if rows:
        con.executemany("insert into documents values (?, ?, ?, ?, ?, ?, ?, ?)", rows)
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    return [dict(zip(names, r, strict=True)) for r in got.fetchall()]


def rounded(rows):
    return sorted((tuple(sorted((k, round(v, 9) if isinstance(v, float) else v) for k, v in r.items())) for r in rows), key=str)


@pytest.fixture(scope="module")
def more(doc_rows):
    repeat = "the cat sat on the mat today "
    odd = [repeat * 3, repeat + "and " + repeat, "a\na\nb\n \n\na", "# # # " * 20, "| x y z " * 12, "w " * 4, "\r\x0b\x0c a", "z" * 1500 + " a" * 20, "1 2 3 4 5 6 7 8 9 10 11 12", "é ñ   x " * 5]
    rows = doc_rows + [(1000 + i, t, "en", "s9", 1, "c", 0.5, 1) for i, t in enumerate(odd)]
    return rows + rows[20:30] + [(None, "some null id with a few words in it more", None, None, None, None, None, None)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, key double, n long"


@pytest.mark.parametrize("empty", [False, True])
def test_quality_rules(spark, more, empty):
    rows = [] if empty else more
    got = quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA).repartition(3)).drop("rejected_by")
    assert rounded(r.asDict() for r in got.collect()) == rounded(run(quality_rules.ORACLE_SQL, rows))


def test_cascade_order_does_not_change_the_verdict(spark, more):
    df = spark.createDataFrame(more, SCHEMA)
    a = quality_rules.quality_rules(df, rules=quality_rules.RULES).select("doc_id", "kept").collect()
    b = quality_rules.quality_rules(df, rules=tuple(reversed(quality_rules.RULES)), sample_rows=3).select("doc_id", "kept").collect()
    assert a == b


def test_the_order_is_the_same_in_every_run(spark, more):
    sample = quality_rules.spread_sample(spark.createDataFrame(more, SCHEMA), 50)
    for made in (True, False):
        runs = [[(r.name, share, work) for r, share, work in quality_rules.ordered(sample, (*quality_rules.BASE_RULES, *quality_rules.RULES), made=made)] for _ in range(2)]
        assert runs[0] == runs[1]
        worth = [share / work for _, share, work in runs[0]]
        assert worth == sorted(worth, reverse=True)


def test_keep_good_keeps_what_the_verdict_keeps(spark, more, no_docs):
    df = spark.createDataFrame(more, SCHEMA)
    want = [r.doc_id for r in quality_rules.quality_rules(df).where("kept").collect()]
    for rules in (quality_rules.RULES, tuple(reversed(quality_rules.RULES))):
        out = quality_rules.keep_good(df, rules=rules)
        assert out.columns == df.columns and sorted((r.doc_id for r in out.collect()), key=str) == sorted(want, key=str)
    assert quality_rules.keep_good(no_docs).count() == 0


def test_repeated_windows_whose_hashes_are_alike(spark):
    """The slow way, taken where upper bits of different windows agree or a text is very long, counts the same."""
    from pyspark.sql import functions as F

    words = [("a b c d e f " * 5).split(), "a b c d e x a b c d e".split(), "p q r s t u v".split(), ["w"] * 40]
    df = spark.createDataFrame([(w,) for w in words], "w array<string>")
    fast = [r[0] for r in df.select(quality_rules.repeated_words(F.col("w"))).collect()]
    slow = [r[0] for r in df.select(quality_rules.repeated_words(F.col("w"), least=0)).collect()]
    assert fast == slow == [30, 10, 0, 40]


@pytest.mark.parametrize("empty", [False, True])
@pytest.mark.parametrize("buckets", [None, 7])
def test_mixing(spark, more, empty, buckets):
    rows = [] if empty else more
    got = mixing.mix_plan(spark.createDataFrame(rows, SCHEMA).repartition(3), buckets=buckets)
    assert rounded(r.asDict() for r in got.collect()) == rounded(run(mixing.ORACLE_SQL, rows))


def test_mix_takes_what_it_plans(spark, more):
    df = spark.createDataFrame(more, SCHEMA)
    plan = mixing.mix_plan(df).collect()
    assert all(r.taken <= 3 * r["size"] for r in plan)
    for source in {r.source for r in plan}:
        own = [r for r in plan if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r["size"] for r in own) / 2 + 1
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    assert mixed.count() == sum(r.epochs for r in plan)


def test_native(spark, more):
    out = quality_rules.quality_rules(spark.createDataFrame(more, SCHEMA))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "PythonUDF" not in plan and "Exchange" not in plan
