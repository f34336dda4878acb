import pytest
from pyspark.sql import functions as F

from sortwright.functions import keycodec as kc
from sortwright.operators import adjacent, costs, keystats, sorting, verify
from sortwright.sources import generators, records, tables


@pytest.mark.parametrize("name", generators.DISTRIBUTIONS)
@pytest.mark.parametrize("n", [1, 3, 511, 1024])
def test_rank_is_a_sorted_permutation(spark, name, n):
    df = generators.records(spark, n, name)
    rows = sorting.ranked(df, ["key", "id"]).orderBy("pos").collect()
    assert [r["pos"] for r in rows] == list(range(1, n + 1))
    assert [(r["key"], r["id"]) for r in rows] == sorted((r["key"], r["id"]) for r in df.collect())


def test_few_distinct_keys_are_cut_into_ranges_and_stay_stable(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(0, 8000, 1, 4).select("id", (F.col("id") % 10).alias("key"))
        table = sorting.numbered(df, ["key"], partitions=6)
        sizes = [r[0] for r in table.groupBy(F.shiftright("__at", sorting.ROW_BITS)).count().select("count").collect()]
        assert len(sizes) == 6 and max(sizes) < 3000
        one = sorting.numbered(df.withColumn("key", F.lit(1)), ["key"], partitions=6)
        assert max(r["count"] for r in one.groupBy(F.shiftright("__at", sorting.ROW_BITS)).count().collect()) < 3000
        for down in (False, True):
            rows = sorting.ranked(df, ["key"], descending=down).orderBy("pos").collect()
            assert [(r["key"], r["id"]) for r in rows] == sorted(((r["key"], r["id"]) for r in df.collect()), key=lambda x: (-x[0] if down else x[0], x[1]))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_plan_of_a_rank_holds_no_splitters(spark):
    df = generators.records(spark, 5000)
    plan = sorting.ranked(df, ["key", "id"])._jdf.queryExecution().toString()
    assert "CASE WHEN" not in plan and "BroadcastHashJoin" in plan


def test_null_keys_come_first(spark):
    df = spark.createDataFrame([(3,), (None,), (1,), (None,), (2,)], "k int")
    assert [r["k"] for r in sorting.ranked(df, ["k"]).orderBy("pos").collect()] == [None, None, 1, 2, 3]


def test_sort_options(spark):
    df = generators.records(spark, 700, "few_unique").select(F.unhex("key").alias("rec"), "id")
    for cfg in (sorting.SortConfig(keys=("rec",)), sorting.SortConfig(keys=("rec", "id"), verify=True), sorting.SortConfig(keys=("rec",), descending=True, verify=True), sorting.SortConfig(preset="gensort", partitions=3), sorting.SortConfig(keys=("rec",), stable=False)):
        out = sorting.sort(df, cfg)
        assert out.columns == df.columns
        keys = [bytes(r["rec"]) for r in out.collect()]
        assert keys == sorted(keys, reverse=cfg.descending) and len(keys) == 700
    with pytest.raises(ValueError):
        sorting.sort(df, sorting.SortConfig())


def test_rank_in_groups_of_any_size(spark):
    df = spark.range(0, 3000, 1, 4).select(F.concat((F.col("id") % 2).cast("string"), F.lpad(((F.col("id") * 7919) % 3000).cast("string"), 5, "0")).alias("key"))
    rows = sorting.in_group_rank(df, "key", F.substring("key", 1, 1)).collect()
    for g in "01":
        mine = sorted(r["key"] for r in rows if r["key"][0] == g)
        assert {r["key"]: r["in_group"] for r in rows if r["key"][0] == g} == {k: i + 1 for i, k in enumerate(mine)}


def test_sampled_rows_are_the_same_on_every_run(spark):
    df = spark.range(1000)
    a = [r["id"] for r in sorting.sampled(df, "id", 50).collect()]
    assert a == [r["id"] for r in sorting.sampled(df.repartition(7), "id", 50).collect()] and len(set(a)) == 50


@pytest.mark.parametrize("bits", [1, 5, 13, 16, 31, 32])
def test_words_unpack_to_what_was_packed(spark, bits):
    n = 203
    values = [(i, (i * 2654435761 + 17) % (1 << bits)) for i in range(n)]
    df = spark.createDataFrame(values, "pos long, v long")
    words = keystats.pack_words(df, "v", "pos", bits)
    stream = 0
    for i, v in values:
        stream |= v << (i * bits)
    assert {r["word"]: r["packed"] for r in words.collect()} == {k: stream >> (32 * k) & 0xFFFFFFFF for k in range(-(-n * bits // 32))}
    assert [(r["pos"], r["value"]) for r in keystats.unpack_words(words, n, bits).orderBy("pos").collect()] == values
    with pytest.raises(ValueError):
        keystats.pack_words(df, "v", "pos", 33)


def test_byte_statistics(spark):
    keys = [bytes([0, i % 3, i % 251, 255]) for i in range(1000)]
    df = spark.createDataFrame([(k,) for k in keys] + [(None,)], "key binary").repartition(3)
    got = {(r["byte_pos"], r["byte"]): r["n"] for r in keystats.histogram(df, "key", 4).collect()}
    assert got == {(p, b): sum(k[p] == b for k in keys) for p in range(4) for b in {k[p] for k in keys}}
    assert {r["byte_pos"]: (r["lo"], r["hi"]) for r in keystats.byte_ranges(df, "key", 4).collect()} == {p: (min(k[p] for k in keys), max(k[p] for k in keys)) for p in range(4)}
    assert keystats.varying(df, "key", 4) == [1, 2] and keystats.varying(df.limit(0), "key", 4) == []
    with pytest.raises(Exception, match="bytes long"):
        keystats.histogram(df, "key", 3).collect()


def test_dictionaries_take_whole_bytes(spark):
    df = spark.range(1000).select(F.col("id").alias("many"), F.lit(7).alias("one"), (F.col("id") % 300).alias("some"))
    got = {(r["col"], r["codec"]): r for r in keystats.codec_sizes(df, {c: F.col(c) for c in df.columns}).collect()}
    assert [got[c, "dictionary"]["bytes_per_value"] for c in ("many", "one", "some")] == [2, 1, 2]
    assert got["many", "mostly_dict"]["n_escape"] == 1000 - 254 and got["one", "mostly_dict"]["coverage"] == 1


def test_result_files_are_typed(spark, tmp_path):
    path = f"file://{tmp_path}/r"
    row = ("none", 10, "random", "2way", 1.5, 0.5, 1.0, 2.0, 3.0, 4, 5.0, "pass")
    tables.write_results(spark.createDataFrame([row], tables.RESULT), path)
    back = tables.read_results(spark, path)
    assert back.first() == row and dict(back.dtypes)["merge_passes"] == "int"
    (tmp_path / "bad.csv").write_text(",".join(back.columns) + "\nnone,x,random,2way,1,1,1,1,1,1,1,pass\n")
    with pytest.raises(Exception):
        tables.read_results(spark, f"file://{tmp_path}/bad.csv").collect()


def test_fetch_in_chunks(spark):
    assert [len(c) for c in tables.fetch(spark.range(25), 10)] == [10, 10, 5] and list(tables.fetch(spark.range(0), 10)) == []


def test_costs(spark):
    row = spark.range(1).select(costs.passes(F.lit(512), F.lit(8)).alias("p"), costs.passes(F.lit(1), F.lit(2)).alias("none"), costs.merge_sort_ms(F.lit(512 * 8), F.lit(1000), 512, F.lit(8), 1.0, 2.0).alias("ms"), costs.human_size(F.lit(2_500_000)).alias("h")).first()
    assert (row["p"], row["none"], row["h"]) == (3, 0, "2M") and row["ms"] == pytest.approx(4.096 + 2 * 4.096 / 2)


def test_empty_input(spark):
    assert sorting.ranked(generators.records(spark, 0), ["key", "id"]).count() == 0


def test_keys_compare_as_their_columns(spark):
    rows = [(-1.5, "1969-12-31"), (0.0, "1970-01-01"), (0.01, "2000-02-29"), (99999.99, "1950-01-01"), (-0.01, "2030-01-01")]
    df = spark.createDataFrame(rows, "v double, d string").withColumn("k", kc.decimal("v")).withColumn("kd", kc.date("d", bias=True))
    assert [r["v"] for r in df.orderBy("k").collect()] == sorted(r[0] for r in rows)
    assert [r["d"] for r in df.orderBy("kd").collect()] == sorted(r[1] for r in rows)
    assert [r["v"] for r in df.orderBy(kc.decimal("v", flip=False)).collect()] == sorted(r[0] for r in rows)


def test_a_byte_that_varies_in_one_row_is_found(spark):
    df = spark.range(2000).select(F.unhex(F.when(F.col("id") == 1234, "0042ff").otherwise("004200")).alias("key"))
    assert keystats.varying(df, "key", 3) == [2]


def test_verifiers_fail_on_bad_outputs(spark):
    good = spark.range(5000).select((F.col("id") + 1).alias("pos"), F.col("id").alias("key"))
    assert verify.violations(good, "key", "pos", 1000).first()["n_violations"] == 0
    swapped = good.withColumn("key", F.when(F.col("pos") == 1000, 1000).when(F.col("pos") == 1001, 999).otherwise(F.col("key")))
    assert verify.violations(swapped, "key", "pos", 1000).first().asDict() == {"n_violations": 1, "first_pos": 1001}
    repeated = good.withColumn("key", F.lit(7).cast("bigint"))
    assert verify.violations(repeated, "key", "pos", 1000).first()["n_violations"] == 0
    assert verify.multiset_diff(good, repeated, "key").count() > 0


def test_fnv_sum(spark):
    data = [b"", b"a", b"foobar", b"\xff" * 9]
    df = spark.createDataFrame([(x,) for x in data], "rec binary")

    def fnv(x):
        h = 0xCBF29CE484222325
        for c in x:
            h = (h ^ c) * 0x100000001B3 % 2**64
        return h

    assert int(verify.fnv1a64_sum(df, "rec").first()["fnv_sum"]) == sum(map(fnv, data)) % 2**64


def test_keys_as_numbers_and_back(spark):
    data = [b"\x00" * 10, b"\xff" * 10, b"\x80" + b"\x01" * 9]
    k = F.col("k")
    df = spark.createDataFrame([(x,) for x in data], "k binary").select("k", kc.prefix_number(k).alias("hi"), F.conv(F.hex(kc.chunk(k, 8, 2)), 16, 10).cast("bigint").alias("lo"))
    for r in df.withColumn("back", kc.short_key(F.col("hi"), F.col("lo"))).collect():
        assert (int(r["hi"]), r["lo"], bytes(r["back"])) == (int.from_bytes(r["k"][:8], "big"), int.from_bytes(r["k"][8:], "big"), bytes(r["k"]))
    pairs = spark.createDataFrame([(b"aB", b"bA"), (b"ab", b"ab"), (b"a", b"ab")], "a binary, b binary")
    assert [tuple(r) for r in pairs.select(kc.compare(F.col("a"), F.col("b")), kc.compare(F.col("a"), F.col("b"), 1)).collect()] == [(-1, 1), (0, 0), (-1, -1)]


def test_shared_folder_is_asked_of_a_cluster():
    from types import SimpleNamespace

    from sortwright.operators import storage

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://x:7077"))
    with pytest.raises(ValueError, match="checkpoint"):
        storage.shared_dir(cluster)


def test_offset_value_codes(spark):
    df = spark.createDataFrame([(None, b"abc"), (b"abc", b"abc"), (b"abc", b"abd"), (b"abc", b"b\x00\x01")], "p binary, k binary")
    codes = [r[0] for r in df.select(adjacent.ovc(F.col("p"), F.col("k"), 3)).collect()]
    assert codes == [adjacent.INITIAL, adjacent.DUPLICATE, adjacent.NORMAL | (8191 - 2) << 16 | ord("d") << 8, adjacent.NORMAL | 8191 << 16 | ord("b") << 8]


def test_record_files(spark, tmp_path):
    df = generators.records(spark, 100).select(F.unhex("key").alias("key"), F.unhex(F.lpad(F.hex("id"), 12, "0")).alias("payload"))
    records.write_records(df.orderBy("key"), f"file://{tmp_path}/out")
    back = records.read_records(spark, f"file://{tmp_path}/out", 4, 6)
    assert sorted(map(tuple, back.select("key", "payload").collect())) == sorted(map(tuple, df.collect()))
    small = records.read_records(spark, f"file://{tmp_path}/out", 4, 6, block_bytes=70).orderBy("rid").collect()
    assert [r["rid"] for r in small] == list(range(100)) and [bytes(r["key"]) for r in small] == sorted(bytes(r["key"]) for r in small)
    (tmp_path / "odd").write_bytes(bytes(range(25)))
    with pytest.raises(ValueError):
        records.read_records(spark, f"file://{tmp_path}/odd", 4, 6)
    assert records.read_records(spark, f"file://{tmp_path}/odd", 4, 6, on_partial="drop").count() == 2
    odd = records.read_records(spark, f"file://{tmp_path}/odd", 4, 6, on_partial="drop").orderBy("rid").collect()
    raw = (tmp_path / "odd").read_bytes()
    assert [(r["rid"], bytes(r["key"] + r["payload"])) for r in odd] == [(i, raw[10 * i : 10 * i + 10]) for i in range(2)]
