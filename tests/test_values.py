import datetime

from pyspark.sql import functions as F

from tarnloom.functions import values
from tarnloom.operators import submit


def column(spark, texts, fn):
    df = spark.createDataFrame([(t,) for t in texts], "v string").coalesce(1)
    return [r[0] for r in df.select(fn(F.col("v"))).collect()]


def test_canonical(spark):
    cases = {'{"b": 1, "a": "x"}': '{"a":"x","b":1}', '"{\\"b\\": 1 }"': '{"b": 1 }', "[1]": None, '"[1]"': None, "1": None, "nope": None, "": None, "{}": "{}", None: None, '"plain"': None}
    assert column(spark, list(cases), values.canonical) == list(cases.values())


def test_iscc_field_is_strict(spark):
    cases = {
        '{"ISCC":"A"}': "A", '{"iscc":"b"}': "b", '{"Iscc":"c"}': "c", '{"ISCC":"A","iscc":"b"}': "A", '{"iscc":"b","ISCC":"A"}': "A", '{"x":1}': None, '{"iscc":5}': None, '{"ISCC":5,"iscc":"b"}': None,
        "no": None, "[]": None, '{"isCc":"d","iscC":"e"}': "d", '{"o":{"iscc":"x"}}': None,
    }
    assert column(spark, list(cases), values.iscc_field) == list(cases.values())
    assert column(spark, ['{"ISCC":"A","iscc":"b"}', '{"ISCC":"A"}', '{"Iscc":"c"}', "no"], values.listed_iscc) == ["b", "A", "-", "-"]


def test_declared_timestamp_is_strict(spark):
    cases = ['{"timestamp":1700000000123}', '{"timestamp":"1700000000123"}', '{"timestamp":1.5}', '{"timestamp":null}', '{"timestamp":"2024-01-01"}', "[]", "no"]
    got = column(spark, cases, values.declared_at)
    assert got[0] == datetime.datetime(2023, 11, 14, 22, 13, 20, 123000) or got[0].timestamp() == 1700000000.123
    assert got[1:] == [None] * 6


def test_reject_order_and_size(spark):
    key = "f01551220" + "ab" * 32
    rows = [("bad", "[", None), (key, "[", None), (key, '{"a":"' + "é" * 40000 + '"}', None), (key, '{"a":"' + "x" * (65536 - 8) + '"}', None)]
    df = spark.createDataFrame([(i, k, v) for i, (k, v, _) in enumerate(rows)], "seq long, key string, value string").coalesce(1)
    got = submit.derive(df, F.timestamp_seconds(F.lit(0))).orderBy("seq").collect()
    assert [r.error for r in got] == ["invalid_key", "invalid_value", "value_too_large", None]
    assert got[3].size == 65536
    assert df.select(submit.http_status(F.lit("value_too_large"))).first()[0] == 413


def test_short_id_and_rfc3339(spark):
    r = spark.range(1).select(values.short_id(F.lit("abcdefghijklmnop")).alias("a"), values.short_id(F.lit("abc")).alias("b"), values.rfc3339(F.timestamp_seconds(F.lit(0))).alias("t")).first()
    assert (r.a, r.b, r.t) == ("abcdefghijkl…", "abc", "1970-01-01T00:00:00.000Z")
