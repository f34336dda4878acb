"""Registered queries over the shared test tables, each with DuckDB SQL for the
same rows. Results with an order carry it in ``pos``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sortwright.functions import keycodec as kc
from sortwright.operators import adjacent, costs, keystats, sorting, storage, verify
from sortwright.sources import generators, records, tables

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[name or f.__name__] = f
        if sql:
            _SQL[name or f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


WIDTH = kc.lineitem_spec().width
_S = "lpad(hex(CAST(round({0}*100) AS BIGINT)::HUGEINT + 9223372036854775808::HUGEINT),16,'0')"
K = "hex(l_returnflag)||hex(l_linestatus)||lpad(hex(date_diff('day',DATE '1970-01-01',l_shipdate::DATE)::BIGINT),8,'0')||" + "||".join(_S.format(c) for c in ("l_extendedprice", "l_discount", "l_tax", "l_quantity")) + "||lpad(hex(l_orderkey::BIGINT),16,'0')||lpad(hex(l_partkey::BIGINT),8,'0')||lpad(hex(l_suppkey::BIGINT),8,'0')||lpad(hex(l_linenumber::BIGINT),8,'0')"
LK = f"k AS (SELECT *, {K} AS key FROM lineitem)"
EK = "e AS (SELECT *, lpad(hex(user_id::BIGINT),16,'0')||lpad(hex(epoch_us(ts)+4611686018427387904),16,'0')||lpad(hex(event_id::BIGINT),16,'0') AS key FROM events)"


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").withColumn("key", kc.lineitem_spec().key())


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").withColumn("key", kc.events_spec().key())


def lineitem_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorting.ranked(lineitem(spark, sf_dir).select("key"), ["key"])


def events_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorting.ranked(events(spark, sf_dir).select("key", "event_id"), ["key"])


def h(c: str = "key"):
    return F.hex(c).alias(c)


# -- keys and sorts --------------------------------------------------------


@query(f"WITH {LK} SELECT l_orderkey, l_linenumber, key FROM k")
def normalize_key(spark, sf_dir):
    return lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", h())


@query(f"WITH {LK} SELECT row_number() OVER (ORDER BY key) AS pos, key FROM k")
def sort_lineitem_normalized(spark, sf_dir):
    return lineitem_ranked(spark, sf_dir).select("pos", h())


TYPED = ["l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax", "l_quantity", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"]


@query(f"SELECT row_number() OVER (ORDER BY {', '.join(TYPED)}) AS pos, l_shipdate::DATE::VARCHAR AS ship, l_orderkey, l_linenumber, l_extendedprice FROM lineitem")
def sort_typed_multicol(spark, sf_dir):
    return sorting.ranked(read(spark, sf_dir, "lineitem").select(*TYPED), TYPED).select("pos", F.col("l_shipdate").cast("date").cast("string").alias("ship"), "l_orderkey", "l_linenumber", "l_extendedprice")


@query(f"WITH {LK} SELECT row_number() OVER (ORDER BY key DESC) AS pos, key FROM k")
def sort_reverse(spark, sf_dir):
    return sorting.ranked(lineitem(spark, sf_dir).select("key"), ["key"], descending=True).select("pos", h())


@query(f"WITH {LK} SELECT key FROM k")
def sort_verified(spark, sf_dir):
    """The public sort with its own check of order and multiset."""
    return sorting.sort(lineitem(spark, sf_dir).select("key"), sorting.SortConfig(keys=("key",), verify=True)).select(h())


@query(f"WITH {EK} SELECT row_number() OVER (ORDER BY substr(key,1,20), event_id) AS pos, event_id FROM e")
def sort_preset(spark, sf_dir):
    """Records of 10 key bytes, stable: equal keys in the order of the input."""
    df = events(spark, sf_dir).select("event_id", F.col("key").alias("rec")).withColumn("k", kc.chunk(F.col("rec"), 0, kc.PRESETS["gensort"][0]))
    return sorting.ranked(df, ["k", "event_id"]).select("pos", "event_id")


@query("SELECT page, min(pos) AS first, max(pos) AS last, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS pos, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS page FROM orders) GROUP BY page")
def paged_scan(spark, sf_dir):
    """Pages of a fixed order, all from one range exchange."""
    page = sorting.ranked(read(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"]).withColumn("page", F.floor((F.col("pos") - 1) / 1000))
    return page.groupBy("page").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))


@query("SELECT event_id, user_id FROM events ORDER BY md5(event_id::VARCHAR), event_id LIMIT 500")
def sample_rows(spark, sf_dir):
    """A sample of fixed size by a hash of the key."""
    return sorting.sampled(read(spark, sf_dir, "events").select("event_id", "user_id"), "event_id", 500)


@query("SELECT row_number() OVER (ORDER BY o_orderkey) AS pos, lpad(hex(o_orderkey::BIGINT),16,'0')||'0000' AS key FROM orders")
def sort_orderkey_10b(spark, sf_dir):
    df = read(spark, sf_dir, "orders").select(F.concat(kc.unsigned("o_orderkey", 8), F.unhex(F.lit("0000"))).alias("key"))
    return sorting.ranked(df, ["key"]).select("pos", h())


@query("SELECT row_number() OVER (ORDER BY event_type, user_id, ts, value, event_id) AS pos, event_type, user_id, event_id FROM events")
def sort_events_lowcard_first(spark, sf_dir):
    keys = ["event_type", "user_id", "ts", "value", "event_id"]
    return sorting.ranked(read(spark, sf_dir, "events").select(*keys), keys).select("pos", "event_type", "user_id", "event_id")


@query(f"WITH {LK}, r AS (SELECT key, row_number() OVER (ORDER BY key) AS pos FROM k) SELECT pos, key FROM r")
def sort_by_compact_key(spark, sf_dir):
    df = lineitem(spark, sf_dir).select("key")
    small = df.withColumn("ckey", kc.compact(F.col("key"), keystats.varying(df, "key", WIDTH)))
    return sorting.ranked(small, ["ckey"]).select("pos", h())


@query(f"WITH {LK} SELECT row_number() OVER (ORDER BY substr(key,1,16), substr(key,17,16), substr(key,33,16), substr(key,49,16), substr(key,65,16), substr(key,81,16), substr(key,97,20)) AS pos, key FROM k")
def sort_lsd_chunks(spark, sf_dir):
    """Successive stable passes over 8-byte chunks are one sort by all chunks."""
    df = lineitem(spark, sf_dir).select("key", *(kc.chunk(F.col("key"), 8 * i, 8).alias(f"c{i}") for i in range(8)))
    return sorting.ranked(df, [f"c{i}" for i in range(8)]).select("pos", h())


@query("SELECT row_number() OVER (ORDER BY (event_id * 7919) & 4095, event_id) AS pos, event_id, (event_id * 7919) & 4095 AS low FROM events")
def truncated_bit_sort(spark, sf_dir):
    df = read(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 7919).bitwiseAND(F.lit(4095).cast("bigint")).alias("low"))
    return sorting.ranked(df, ["low", "event_id"])


@query(f"WITH {LK} SELECT key, row_number() OVER (ORDER BY key) AS pos FROM k ORDER BY key LIMIT 254")
def topk_by_key(spark, sf_dir):
    best = sorting.top(lineitem(spark, sf_dir).select("key"), [F.col("key")], 254)
    return best.withColumn("pos", F.row_number().over(Window.orderBy("key")).cast("bigint")).select(h(), "pos")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def limit_offset_ordered(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(100).limit(50)


@query(f"WITH {EK} SELECT row_number() OVER (ORDER BY key) AS pos, event_id AS rid FROM e")
def rank_permutation(spark, sf_dir):
    return events_ranked(spark, sf_dir).select("pos", F.col("event_id").alias("rid"))


@query(f"WITH {EK}, p AS (SELECT row_number() OVER (ORDER BY key) AS pos, event_id FROM e) SELECT pos, event_id, event_type, value FROM p JOIN events USING (event_id)")
def gather_by_permutation(spark, sf_dir):
    perm = events_ranked(spark, sf_dir).select("pos", "event_id")
    return sorting.gather(read(spark, sf_dir, "events").select("event_id", "event_type", "value"), perm, "event_id").select("pos", "event_id", "event_type", "value")


@query("WITH p AS (SELECT event_id, user_id % 16 AS part FROM events) SELECT part, event_id, row_number() OVER (ORDER BY part, event_id) - 1 AS dest FROM p")
def stable_partition_scatter(spark, sf_dir):
    df = read(spark, sf_dir, "events").select((F.col("user_id") % 16).alias("part"), "event_id")
    return sorting.ranked(df, ["part", "event_id"]).select("part", "event_id", (F.col("pos") - 1).alias("dest"))


# -- projections and filters -----------------------------------------------


@query("SELECT event_id, coalesce(value, 0.0)::INTEGER AS v, coalesce(event_type, 'N') AS t FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL")
def coalesce_filter_notnull(spark, sf_dir):
    df = read(spark, sf_dir, "events").filter("ts is not null and user_id is not null")
    return df.select("event_id", F.bround(F.coalesce("value", F.lit(0.0))).cast("int").alias("v"), F.coalesce("event_type", F.lit("N")).alias("t"))


@query("SELECT o_orderkey, lpad(hex(greatest(0, least(255, floor(o_totalprice / 1000)))::BIGINT),2,'0') AS u8, lpad(hex(greatest(0, least(65535, floor(o_totalprice) - 1000))::BIGINT),4,'0') AS u16, CASE WHEN o_orderstatus = 'F' THEN '01' ELSE '00' END AS flag FROM orders")
def clamp_encode_uint8_16(spark, sf_dir):
    df = read(spark, sf_dir, "orders")
    return df.select("o_orderkey", F.hex(kc.clamped(F.floor(F.col("o_totalprice") / 1000), 1)).alias("u8"), F.hex(kc.clamped(F.floor("o_totalprice") - 1000, 2)).alias("u16"), F.hex(kc.flag(F.col("o_orderstatus"), "F")).alias("flag"))


_TRIP = "t AS (SELECT event_id, event_id % 300 AS vendor_id, CASE WHEN event_id % 7 <> 3 THEN event_id % 5 END AS payment_type, user_id % 70000 AS pickup_location, event_id % 265 AS dropoff_location, event_id % 6 AS passenger_count, -(event_id % 3) AS ratecode_id, epoch_us(ts) AS up, epoch_us(ts) + 60000000 * (event_id % 90) AS down, CASE WHEN event_id % 11 <> 5 THEN value END AS fare, event_type AS kind FROM events)"


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the shape of taxi trips, with nulls and values out of range."""
    i, minute = F.col("event_id"), F.make_dt_interval(mins=(F.col("event_id") % 90).cast("int"))
    fare = F.when(i % 11 != 5, F.col("value"))
    return read(spark, sf_dir, "events").select(
        "event_id", (i % 300).alias("vendor_id"), F.when(i % 7 != 3, i % 5).alias("payment_type"), (F.col("user_id") % 70000).alias("pickup_location"), (i % 265).alias("dropoff_location"), (i % 6).alias("passenger_count"), (-(i % 3)).alias("ratecode_id"),
        F.col("ts").alias("pickup"), (F.col("ts") + minute).alias("dropoff"), fare.alias("fare"), F.lit(None).cast("double").alias("tip"), fare.alias("total"), fare.alias("distance"), F.lit(1.25).alias("tolls"), F.when(F.col("event_type") == "click", "Y").otherwise("N").alias("store_and_forward"),
    )


@query(f"WITH {_TRIP}, v AS (SELECT *, coalesce(fare, 0.0) AS f, 4611686018427387904 AS o FROM t) SELECT event_id, lpad(hex(least(255, vendor_id)::BIGINT),2,'0')||lpad(hex(coalesce(payment_type, 0)::BIGINT),2,'0')||lpad(hex(least(65535, pickup_location)::BIGINT),4,'0')||lpad(hex(dropoff_location::BIGINT),4,'0')||lpad(hex(passenger_count::BIGINT),2,'0')||'00'||lpad(hex(up + o),16,'0')||lpad(hex(down + o),16,'0')||lpad(hex(round_even(f * 100, 0)::BIGINT + o),16,'0')||lpad(hex(o),16,'0')||lpad(hex(round_even(f * 100, 0)::BIGINT + o),16,'0')||lpad(hex(round_even(f * 1609344, 0)::BIGINT + o),16,'0')||lpad(hex(125 + o),16,'0')||CASE WHEN kind = 'click' THEN '01' ELSE '00' END||'00' AS key FROM v")
def taxi_normalize(spark, sf_dir):
    return trips(spark, sf_dir).select("event_id", F.hex(kc.taxi_spec().key()).alias("key"))


@query("SELECT o_orderkey, lpad(hex((date_diff('day',DATE '1970-01-01',o_orderdate::DATE)+2147483648)::BIGINT),8,'0') AS d, lpad(hex((round(o_totalprice*100)::BIGINT)+4611686018427387904),16,'0') AS m FROM orders")
def biased_encodings(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", F.hex(kc.date("o_orderdate", bias=True)).alias("d"), F.hex(kc.decimal("o_totalprice", flip=False)).alias("m"))


@query(f"WITH {EK} SELECT event_id, substr(key,1,16) AS c0, substr(key,17,16) AS c1, substr(key,1,8) AS c4, substr(key,17,4) AS tie FROM e")
def prefix_chunks(spark, sf_dir):
    k = F.col("key")
    return events(spark, sf_dir).select("event_id", F.hex(kc.chunk(k, 0, 8)).alias("c0"), F.hex(kc.chunk(k, 8, 8)).alias("c1"), F.hex(kc.chunk(k, 0, 4)).alias("c4"), F.hex(kc.chunk(k, 8, 2)).alias("tie"))


def _zeroed(n: int) -> None:
    @query(f"WITH {LK}, z AS (SELECT '{'00' * n}'||substr(key,{2 * n + 1}) AS zkey, key FROM k) SELECT row_number() OVER (ORDER BY zkey, key) AS pos, zkey FROM z", f"adversarial_zero{n}")
    def run(spark, sf_dir):
        df = lineitem(spark, sf_dir).select("key", kc.zeroed(F.col("key"), WIDTH, n).alias("zkey"))
        return sorting.ranked(df, ["zkey", "key"]).select("pos", h("zkey"))


_zeroed(8)
_zeroed(32)


def _pooled(n: int, name: str) -> None:
    @query(f"WITH {LK}, t AS (SELECT l_orderkey % {n} AS tpl, key FROM k), z AS (SELECT lpad(hex(((tpl * 2654435761) % 4294967296)::BIGINT), 64, '0')||substr(key,65) AS pkey, key FROM t) SELECT row_number() OVER (ORDER BY pkey, key) AS pos, pkey FROM z", name)
    def run(spark, sf_dir):
        tpl = F.lpad(F.hex((F.col("l_orderkey") % n * 2654435761) % 4294967296), 64, "0")
        df = lineitem(spark, sf_dir).select("key", F.concat(F.unhex(tpl), F.substring("key", 33, WIDTH)).alias("pkey"))
        return sorting.ranked(df, ["pkey", "key"]).select("pos", h("pkey"))


_pooled(32, "adversarial_pool")
_pooled(1000, "adversarial_pool1000")


# -- key statistics and codecs ---------------------------------------------

BYTES = f"b AS (SELECT p AS byte_pos, ('0x'||substr(key, 2*p+1, 2))::INTEGER AS byte FROM k, range({WIDTH}) t(p))"


@query(f"WITH {LK}, {BYTES} SELECT byte_pos::INTEGER AS byte_pos, min(byte) AS lo, max(byte) AS hi, min(byte) <> max(byte) AS varies FROM b GROUP BY byte_pos")
def varying_bytes(spark, sf_dir):
    return keystats.byte_ranges(lineitem(spark, sf_dir), "key", WIDTH).withColumn("varies", F.col("lo") != F.col("hi"))


_COMPACT = f"{LK}, {BYTES}, v AS (SELECT byte_pos FROM b GROUP BY byte_pos HAVING min(byte) <> max(byte)), c AS (SELECT key, string_agg(substr(key, 2*byte_pos+1, 2), '' ORDER BY byte_pos) AS ck FROM k, v GROUP BY key)"


@query(f"WITH {_COMPACT} SELECT key, ck||repeat('00', ((8 - (len(ck)//2) % 8) % 8)::BIGINT) AS ckey FROM c")
def compact_key(spark, sf_dir):
    df = lineitem(spark, sf_dir).select("key")
    return df.select(h(), F.hex(kc.compact(F.col("key"), keystats.varying(df, "key", WIDTH))).alias("ckey"))


@query(f"WITH {LK}, {BYTES}, v AS (SELECT byte_pos FROM b GROUP BY byte_pos HAVING min(byte) <> max(byte)) SELECT {WIDTH} AS raw_bytes, count(*) AS compact_bytes, round({WIDTH} / count(*), 6) AS ratio FROM v")
def compact_ratio(spark, sf_dir):
    v = keystats.byte_ranges(lineitem(spark, sf_dir), "key", WIDTH).filter("lo <> hi")
    return v.agg(F.count("*").alias("compact_bytes")).select(F.lit(WIDTH).alias("raw_bytes"), "compact_bytes", F.round(F.lit(WIDTH) / F.col("compact_bytes"), 6).alias("ratio"))


@query(f"WITH {LK}, {BYTES} SELECT byte_pos::INTEGER AS byte_pos, byte, count(*) AS n FROM b GROUP BY ALL")
def byte_histogram(spark, sf_dir):
    return keystats.histogram(lineitem(spark, sf_dir), "key", WIDTH)


_ENTROPY = f"{LK}, {BYTES}, g AS (SELECT byte_pos, byte, count(*) AS n FROM b GROUP BY ALL), q AS (SELECT byte_pos, n / sum(n) OVER (PARTITION BY byte_pos) AS p FROM g), y AS (SELECT byte_pos, count(*) AS n_distinct, sum(-p * log2(p)) AS entropy FROM q GROUP BY byte_pos)"


@query(f"WITH {_ENTROPY} SELECT byte_pos::INTEGER AS byte_pos, n_distinct, round(entropy, 6) + 0.0 AS entropy FROM y")
def byte_entropy(spark, sf_dir):
    return keystats.entropy(lineitem(spark, sf_dir), "key", WIDTH).withColumn("entropy", F.round("entropy", 6) + 0.0)


def _fields() -> list[tuple[str, int, int]]:
    out, at = [], 0
    for name, n, _ in kc.lineitem_spec().fields:
        out.append((name, at, n))
        at += n
    return out


@query(f"WITH {_ENTROPY}, f(col, lo, n) AS (VALUES {', '.join(f'({c!r}, {a}, {n})' for c, a, n in _fields())}) SELECT col, round(sum(entropy), 5) + 0.0 AS entropy FROM y JOIN f ON byte_pos >= lo AND byte_pos < lo + n GROUP BY col")
def column_entropy(spark, sf_dir):
    col = F.lit(None)
    for name, at, n in _fields():
        col = F.when((F.col("byte_pos") >= at) & (F.col("byte_pos") < at + n), name).otherwise(col)
    return keystats.entropy(lineitem(spark, sf_dir), "key", WIDTH).groupBy(col.alias("col")).agg((F.round(F.sum("entropy"), 5) + 0.0).alias("entropy"))


CODEC_COLS = ["l_extendedprice", "l_discount", "l_tax", "l_quantity", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
_LONG = " UNION ALL ".join(f"SELECT '{c}' AS col, {f'round({c}*100)::BIGINT' if i < 4 else f'{c}::BIGINT'} AS v FROM lineitem" for i, c in enumerate(CODEC_COLS))
_CODEC = f"l AS ({_LONG}), g AS (SELECT col, v, count(*) AS n FROM l GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, v) AS r FROM g), s AS (SELECT col, min(v) AS lo, max(v) AS hi, count(*) AS ndv, sum(n) AS n, sum(CASE WHEN r <= 254 THEN n ELSE 0 END) AS hit FROM r GROUP BY col), z AS (SELECT col, CASE WHEN hi > lo THEN ceil(log2(hi - lo + 1)) ELSE 0 END AS bits, CASE WHEN ndv > 1 THEN ceil(log2(ndv)) ELSE 0 END AS dbits, hit / n AS cov, ndv, n - hit AS miss FROM s)"
_SIZES = {"for": "greatest(1, ceil(bits / 8))", "for_bitpack": "bits / 8", "dictionary": "greatest(1, ceil(dbits / 8))", "mostly_dict": "cov + (1 - cov) * 9"}


def codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = {c: kc.cents(c) if i < 4 else F.col(c) for i, c in enumerate(CODEC_COLS)}
    return keystats.codec_sizes(read(spark, sf_dir, "lineitem"), cols)


def _codec(name: str, codec: str) -> None:
    @query(f"WITH {_CODEC} SELECT col, round(({_SIZES[codec]})::DOUBLE, 6) AS bytes_per_value FROM z", name)
    def run(spark, sf_dir):
        return codecs(spark, sf_dir).filter(F.col("codec") == codec).select("col", "bytes_per_value")


_codec("codec_for", "for")
_codec("codec_for_bitpack", "for_bitpack")
_codec("codec_dictionary", "dictionary")
_codec("codec_mostly_op_dict", "mostly_dict")


@query(f"WITH {_CODEC}, a AS ({' UNION ALL '.join(f'SELECT {k!r} AS codec, ({v})::DOUBLE AS b FROM z' for k, v in _SIZES.items())}) SELECT codec, round(sum(round(b, 6)), 4) AS bytes_per_row, count(*) AS cols FROM a GROUP BY codec")
def codec_report(spark, sf_dir):
    return codecs(spark, sf_dir).groupBy("codec").agg(F.round(F.sum("bytes_per_value"), 4).alias("bytes_per_row"), F.count("*").alias("cols"))


RAW = {c: n for c, n, _ in kc.lineitem_spec().fields}
_BITS = {"for": "bits", "for_bitpack": "bits", "dictionary": "dbits", "mostly_dict": "round((cov + (1 - cov) * 9) * 8, 1)"}
_RAW = "CASE col " + " ".join(f"WHEN {c!r} THEN {RAW[c]}" for c in CODEC_COLS) + " END"


@query(f"WITH {_CODEC}, a AS ({' UNION ALL '.join(f'SELECT col, {k!r} AS codec, ({v})::DOUBLE AS b, ({_BITS[k]})::DOUBLE AS bits, ndv, {"cov" if k == "mostly_dict" else "1.0"} AS cov, {"miss" if k == "mostly_dict" else "0"} AS miss FROM z' for k, v in _SIZES.items())}) SELECT col, codec, {_RAW} AS raw_bytes, round(b, 6) AS bytes_per_value, round({_RAW} / greatest(b, CASE WHEN codec IN ('for', 'dictionary') THEN 0.125 ELSE 0.01 END), 2) AS ratio, bits AS bits_per_value, ndv AS n_distinct, round(cov, 6)::DOUBLE AS coverage, miss::BIGINT AS n_escape FROM a")
def codec_detail(spark, sf_dir):
    raw = F.element_at(F.create_map(*(F.lit(x) for c in CODEC_COLS for x in (c, RAW[c]))), F.col("col"))
    least = F.when(F.col("codec").isin("for", "dictionary"), 0.125).otherwise(0.01)
    return codecs(spark, sf_dir).select("col", "codec", raw.alias("raw_bytes"), "bytes_per_value", F.round(raw / F.greatest("bytes_per_value", least), 2).alias("ratio"), "bits_per_value", "n_distinct", "coverage", "n_escape")


_WORDS = "w AS (SELECT word, sum(x)::BIGINT AS packed FROM (SELECT event_id * 13 // 32 AS word, ((user_id & 8191) << (event_id * 13 % 32)::INTEGER) & 4294967295 AS x FROM events UNION ALL SELECT event_id * 13 // 32 + 1, (user_id & 8191) >> (32 - event_id * 13 % 32)::INTEGER FROM events WHERE event_id * 13 % 32 + 13 > 32) GROUP BY word)"


@query(f"WITH {_WORDS} SELECT word, packed FROM w")
def lsb_bitpack_encode(spark, sf_dir):
    return keystats.pack_words(read(spark, sf_dir, "events").select("event_id", "user_id"), "user_id", "event_id", 13)


@query("SELECT event_id AS pos, user_id & 8191 AS value FROM events")
def lsb_bitpack_decode(spark, sf_dir):
    df = read(spark, sf_dir, "events").select("event_id", "user_id")
    return keystats.unpack_words(keystats.pack_words(df, "user_id", "event_id", 13), df.count(), 13)


@query("WITH m AS (SELECT min(l_partkey) AS lo FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey - lo AS enc, (l_partkey - lo) + lo AS dec FROM lineitem, m")
def for_encode_decode(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem")
    lo = F.lit(df.agg(F.min("l_partkey")).first()[0])
    return df.select("l_orderkey", "l_linenumber", (F.col("l_partkey") - lo).alias("enc")).withColumn("dec", F.col("enc") + lo)


@query(f"WITH {LK}, {BYTES}, m AS (SELECT byte_pos, min(byte) AS lo FROM b GROUP BY byte_pos) SELECT key, string_agg(lpad(hex((('0x'||substr(key,2*byte_pos+1,2))::INTEGER - lo)::BIGINT),2,'0'), '' ORDER BY byte_pos) AS enc FROM k, m GROUP BY key")
def for_encode_bytes(spark, sf_dir):
    df = lineitem(spark, sf_dir).select("key")
    lows = [r["lo"] for r in keystats.byte_ranges(df, "key", WIDTH).orderBy("byte_pos").collect()]
    return df.select(h(), F.concat(*(F.lpad(F.hex((keystats.byte_at(F.col("key"), p) - lo).cast("bigint")), 2, "0") for p, lo in enumerate(lows))).alias("enc"))


_PACK = f"{LK}, {BYTES}, m AS (SELECT byte_pos, min(byte) AS lo, CASE WHEN max(byte) > min(byte) THEN ceil(log2(max(byte) - min(byte) + 1))::BIGINT ELSE 0 END AS bits FROM b GROUP BY byte_pos)"


@query(f"WITH {_PACK} SELECT byte_pos::INTEGER AS byte_pos, lo, bits, coalesce(sum(bits) OVER (ORDER BY byte_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS bit_offset FROM m")
def bitpack_config(spark, sf_dir):
    return keystats.bitpack_config(keystats.byte_ranges(lineitem(spark, sf_dir), "key", WIDTH))


@query(f"WITH {_PACK} SELECT key, string_agg(CASE WHEN bits > 0 THEN lpad(bin(('0x'||substr(key,2*byte_pos+1,2))::INTEGER - lo), bits::INTEGER, '0') ELSE '' END, '' ORDER BY byte_pos) AS bits, key AS back FROM k, m GROUP BY key")
def bitpack_roundtrip(spark, sf_dir):
    df = lineitem(spark, sf_dir).select("key")
    config = [(r["byte_pos"], r["lo"], r["bits"]) for r in keystats.bitpack_config(keystats.byte_ranges(df, "key", WIDTH)).orderBy("byte_pos").collect()]
    return df.select(h(), keystats.packed_bits(F.col("key"), config).alias("bits")).withColumn("back", keystats.unpacked(F.col("bits"), config))


# -- runs, offset-value codes, ties ----------------------------------------

RUN = f"{EK}, r AS (SELECT event_id, key, event_id // 512 AS run_id, row_number() OVER (PARTITION BY event_id // 512 ORDER BY key) AS pos FROM e)"


def runs(spark: SparkSession, sf_dir: str, size: int = 512) -> DataFrame:
    """Input cut into runs of ``size`` rows, each sorted apart."""
    df = events(spark, sf_dir).select("event_id", "key", F.floor(F.col("event_id") / size).cast("bigint").alias("run_id"))
    return df.withColumn("pos", F.row_number().over(Window.partitionBy("run_id").orderBy("key")).cast("bigint"))


@query(f"WITH {RUN} SELECT run_id, pos, key FROM r")
def run_generation_512(spark, sf_dir):
    return runs(spark, sf_dir).select("run_id", "pos", h())


def _ovc_sql(source: str, over: str, width: int) -> str:
    case = " ".join(f"WHEN substr(prev,{2 * o + 1},4) <> substr(key,{2 * o + 1},4) THEN {adjacent.NORMAL | (8191 - o) << 16}::BIGINT + ('0x'||substr(key,{2 * o + 1},4))::BIGINT" for o in range(0, width, 2))
    return f"p AS (SELECT *, lag(key) OVER ({over}) AS prev FROM {source}), o AS (SELECT *, CASE WHEN prev IS NULL THEN {adjacent.INITIAL}::BIGINT {case} ELSE {adjacent.DUPLICATE}::BIGINT END AS ovc FROM p)"


@query(f"WITH {RUN}, {_ovc_sql('r', 'PARTITION BY run_id ORDER BY pos', 24)} SELECT run_id, pos, ovc FROM o")
def ovc_per_run(spark, sf_dir):
    prev = F.lag("key").over(Window.partitionBy("run_id").orderBy("pos"))
    return runs(spark, sf_dir).withColumn("prev", prev).select("run_id", "pos", adjacent.ovc(F.col("prev"), F.col("key"), 24).alias("ovc"))


@query(f"WITH {LK}, s AS (SELECT key, row_number() OVER (ORDER BY key) AS pos FROM k), {_ovc_sql('s', 'ORDER BY pos', WIDTH)} SELECT pos, ovc FROM o")
def ovc_whole_run(spark, sf_dir):
    with_prev = adjacent.with_previous(lineitem_ranked(spark, sf_dir), "key", "pos")
    return with_prev.select("pos", adjacent.ovc(F.col("prev"), F.col("key"), WIDTH).alias("ovc"))


@query(f"WITH {RUN}, {_ovc_sql('r', 'PARTITION BY run_id ORDER BY pos', 24)} SELECT ovc >> 29 AS flag, 8191 - ((ovc >> 16) & 8191) AS off, count(*) AS n, max(ovc & 65535) AS top FROM o GROUP BY ALL")
def ovc_fields(spark, sf_dir):
    o = F.col("ovc")
    return ovc_per_run(spark, sf_dir).groupBy(adjacent.ovc_flag(o).alias("flag"), adjacent.ovc_offset(o).alias("off")).agg(F.count("*").alias("n"), F.max(adjacent.ovc_value(o)).alias("top"))


@query(f"WITH {RUN}, {_ovc_sql('r', 'PARTITION BY run_id ORDER BY pos', 24)} SELECT count(*) FILTER (ovc >> 29 = 3) AS initial, count(*) FILTER (ovc >> 29 = 2) AS normal, count(*) FILTER (ovc >> 29 = 1) AS duplicate, count(*) FILTER (ovc >> 29 = 0) AS early, count(*) FILTER (ovc >> 29 = 4) AS late, count(*) FILTER (ovc >> 29 IN (0, 4)) AS fences FROM (SELECT ovc FROM o UNION ALL SELECT 0 UNION ALL SELECT {adjacent.LATE})")
def ovc_predicates(spark, sf_dir):
    """Codes by kind, the two fences added."""
    codes = ovc_per_run(spark, sf_dir).select("ovc").union(spark.createDataFrame([(adjacent.EARLY,), (adjacent.LATE,)], "ovc long"))
    kinds = {"initial": adjacent.is_initial, "normal": adjacent.is_normal, "duplicate": adjacent.is_duplicate, "early": adjacent.is_early, "late": adjacent.is_late, "fences": adjacent.is_fence}
    return codes.agg(*(F.count_if(f(F.col("ovc"))).alias(k) for k, f in kinds.items()))


@query(f"WITH {RUN}, p AS (SELECT run_id, pos, key, lag(key) OVER (PARTITION BY run_id ORDER BY pos) AS prev FROM r) SELECT run_id, pos, CASE WHEN substr(prev, 17) < substr(key, 17) THEN -1 WHEN substr(prev, 17) > substr(key, 17) THEN 1 ELSE 0 END AS c FROM p WHERE prev IS NOT NULL")
def key_compare_from(spark, sf_dir):
    """Neighbours compared from the ninth byte on."""
    prev = F.lag("key").over(Window.partitionBy("run_id").orderBy("pos"))
    return runs(spark, sf_dir).withColumn("prev", prev).filter("prev is not null").select("run_id", "pos", kc.compare(F.col("prev"), F.col("key"), 8).alias("c"))


@query(f"WITH {EK} SELECT event_id, ('0x'||substr(key,1,16))::UBIGINT::VARCHAR AS high, ('0x'||substr(key,17,4))::BIGINT AS low, substr(key,1,20) AS back FROM e")
def sort_key_parts(spark, sf_dir):
    """Ten-byte keys as a 64-bit and a 16-bit number, and back."""
    k = F.col("key")
    parts = events(spark, sf_dir).select("event_id", kc.prefix_number(k).alias("high"), F.conv(F.hex(kc.chunk(k, 8, 2)), 16, 10).cast("bigint").alias("low"))
    return parts.select("event_id", F.col("high").cast("string").alias("high"), "low", F.hex(kc.short_key(F.col("high"), F.col("low"))).alias("back"))


@query(f"WITH {_COMPACT}, p AS (SELECT key, rpad(ck, 32, '0') AS ck FROM c) SELECT key, substr(ck, 1, 16) AS p0, substr(ck, 17, 16) AS p1 FROM p")
def compact_prefix16(spark, sf_dir):
    df = lineitem(spark, sf_dir).select("key")
    ckey = kc.compact(F.col("key"), keystats.varying(df, "key", WIDTH))
    return df.select("key", F.rpad(F.hex(ckey), 32, "0").alias("ckey")).select(h(), F.substring("ckey", 1, 16).alias("p0"), F.substring("ckey", 17, 16).alias("p1"))


@query(f"WITH {RUN} SELECT run_id, (pos - 1) * 24 AS byte_offset, key FROM r WHERE (pos - 1) % 64 = 0")
def sparse_index_64(spark, sf_dir):
    return runs(spark, sf_dir).filter("(pos - 1) % 64 = 0").select("run_id", ((F.col("pos") - 1) * 24).alias("byte_offset"), h())


@query(f"WITH {LK} SELECT count(*) > count(DISTINCT substr(key,1,32)) AS has_ties FROM k")
def tie_check_16b(spark, sf_dir):
    g = lineitem(spark, sf_dir).groupBy(kc.chunk(F.col("key"), 0, 16).alias("p")).agg(F.count("*").alias("n"))
    return g.agg(F.coalesce(F.max("n") > 1, F.lit(False)).alias("has_ties"))


def _ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem(spark, sf_dir).groupBy(kc.chunk(F.col("key"), 0, 8).alias("prefix")).agg(F.count("*").alias("n")).filter("n > 1")


TIES = f"{LK}, t AS (SELECT substr(key,1,16) AS prefix, count(*) AS n FROM k GROUP BY 1 HAVING count(*) > 1)"


@query(f"WITH {TIES} SELECT prefix, n FROM t")
def tie_groups(spark, sf_dir):
    return _ties(spark, sf_dir).select(h("prefix"), "n")


@query(f"WITH {TIES} SELECT count(*) AS n_groups, sum(n)::BIGINT AS n_rows, max(n) AS largest FROM t")
def tie_group_stats(spark, sf_dir):
    return _ties(spark, sf_dir).agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_rows"), F.max("n").alias("largest"))


@query(f"WITH {LK} SELECT key, row_number() OVER (PARTITION BY substr(key,1,16) ORDER BY key) AS in_group FROM k")
def tie_fixup_rank(spark, sf_dir):
    return sorting.in_group_rank(lineitem(spark, sf_dir).select("key"), "key", kc.chunk(F.col("key"), 0, 8)).select(h(), "in_group")


# -- merges and partitioning -----------------------------------------------


@query(f"WITH {EK}, u AS (SELECT key, CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END AS src, event_id FROM e) SELECT row_number() OVER (ORDER BY key, src, event_id) AS pos, src, event_id FROM u")
def merge_2way(spark, sf_dir):
    e = events(spark, sf_dir).select("key", "event_id")
    a, b = (e.filter(F.col("event_id") % 2 == s).withColumn("src", F.lit(s)) for s in (0, 1))
    return sorting.ranked(a.union(b), ["key", "src", "event_id"]).select("pos", "src", "event_id")


@query(f"WITH {EK} SELECT row_number() OVER (ORDER BY key, event_id % 8, event_id) AS pos, event_id % 8 AS run_id, event_id FROM e")
def merge_kway8(spark, sf_dir):
    e = events(spark, sf_dir).select("key", (F.col("event_id") % 8).alias("run_id"), "event_id")
    return sorting.ranked(e, ["key", "run_id", "event_id"]).select("pos", "run_id", "event_id")


@query(f"WITH {EK} SELECT row_number() OVER (ORDER BY ('0x'||substr(key,17,16))::UBIGINT, event_id % 4, event_id) AS pos, event_id % 4 AS run_id, event_id FROM e")
def merge_u64(spark, sf_dir):
    """Runs merged by unsigned 64-bit keys."""
    e = events(spark, sf_dir).select(kc.prefix_number(F.col("key"), 8).alias("k"), (F.col("event_id") % 4).alias("run_id"), "event_id")
    return sorting.ranked(e, ["k", "run_id", "event_id"]).select("pos", "run_id", "event_id")


@query(f"WITH {EK} SELECT row_number() OVER (ORDER BY substr(key,1,32), event_id % 4, event_id) AS pos, event_id FROM e")
def merge_prefix16(spark, sf_dir):
    """Runs merged by a 16-byte prefix; equal prefixes in the order of runs."""
    e = events(spark, sf_dir).select(kc.chunk(F.col("key"), 0, 16).alias("k"), (F.col("event_id") % 4).alias("run_id"), "event_id")
    return sorting.ranked(e, ["k", "run_id", "event_id"]).select("pos", "event_id")


@query(f"WITH {EK} SELECT row_number() OVER (ORDER BY key) AS pos, event_id % 2 AS source, event_id, value FROM e")
def gather_by_source(spark, sf_dir):
    """Payloads of two sources in the order of a permutation of (source, row)."""
    source = (F.col("event_id") % 2).cast("int")
    perm = events_ranked(spark, sf_dir).select("pos", source.alias("source"), "event_id")
    e = read(spark, sf_dir, "events").select("event_id", "value")
    return sorting.gather_from([e.filter(source == k) for k in (0, 1)], perm, "event_id").select("pos", F.col("source").cast("bigint").alias("source"), "event_id", "value")


PARTS = 16
SPLIT = f"{EK}, s AS (SELECT key, row_number() OVER (ORDER BY key) AS pos FROM e), sm AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS i, count(*) OVER () AS m FROM s WHERE (pos - 1) % 16 = 0), sp AS (SELECT t.i AS split, sm.key FROM range(1, {PARTS}) t(i), sm WHERE sm.i = t.i * sm.m // {PARTS}), cl AS (SELECT e.event_id, e.key, e.event_id % 8 AS run_id, (SELECT count(*) FROM sp WHERE e.key >= sp.key) AS part FROM e)"


def split_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``split, key``: evenly spaced quantiles of every 16th key."""
    sample = events_ranked(spark, sf_dir).filter("(pos - 1) % 16 = 0").select("key", F.floor((F.col("pos") - 1) / 16).alias("i"))
    m = sample.count()
    at = spark.range(1, PARTS).select(F.col("id").alias("split"), F.floor(F.col("id") * m / PARTS).alias("i"))
    return at.join(sample, "i").select("split", "key")


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with the range they fall in; a key equal to a splitter goes right."""
    cuts = [(bytes(r["key"]),) for r in split_keys(spark, sf_dir).orderBy("split").collect()]
    e = events(spark, sf_dir).select("event_id", "key", (F.col("event_id") % 8).alias("run_id"))
    return e.withColumn("part", sorting.part_of(["key"], cuts).cast("bigint"))


@query(f"WITH {SPLIT} SELECT split, key FROM sp")
def range_splitters(spark, sf_dir):
    return split_keys(spark, sf_dir).select("split", h())


@query(f"WITH {SPLIT} SELECT event_id, part FROM cl")
def classify_partition(spark, sf_dir):
    return classified(spark, sf_dir).select("event_id", "part")


@query(f"WITH {SPLIT}, c AS (SELECT part, count(*) AS n FROM cl GROUP BY part) SELECT min(n) AS least, max(n) AS most, round(max(n) / (sum(n) / {PARTS}), 6) AS skew FROM c")
def partition_histogram_skew(spark, sf_dir):
    c = classified(spark, sf_dir).groupBy("part").agg(F.count("*").alias("n"))
    return c.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.max("n") / (F.sum("n") / PARTS), 6).alias("skew"))


@query(f"WITH {SPLIT}, c AS (SELECT part, count(*) AS n FROM cl GROUP BY part) SELECT part, n, (sum(n) OVER (ORDER BY part) - n)::BIGINT AS base FROM c")
def partition_offsets(spark, sf_dir):
    c = classified(spark, sf_dir).groupBy("part").agg(F.count("*").alias("n"))
    return c.withColumn("base", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("n"))


@query(f"WITH {SPLIT}, p AS (SELECT run_id, part, row_number() OVER (PARTITION BY run_id ORDER BY key) - 1 AS pos FROM cl) SELECT run_id, part, min(pos) AS start, count(*) AS n FROM p GROUP BY ALL")
def kway_partition_descriptors(spark, sf_dir):
    counts = classified(spark, sf_dir).groupBy("run_id", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("run_id").orderBy("part")) - F.col("n")
    return counts.select("run_id", "part", before.alias("start"), "n")


@query(f"WITH {SPLIT} SELECT cl.run_id, sp.split, count(*) FILTER (cl.key < sp.key) AS lower, count(*) FILTER (cl.key <= sp.key) AS upper FROM cl, sp GROUP BY ALL")
def run_bounds(spark, sf_dir):
    cuts = [(r["split"], bytes(r["key"])) for r in split_keys(spark, sf_dir).orderBy("split").collect()]
    e = events(spark, sf_dir).select("key", (F.col("event_id") % 8).alias("run_id"))
    wide = e.groupBy("run_id").agg(*(F.count_if(F.col("key") < F.lit(k)).alias(f"l{i}") for i, k in cuts), *(F.count_if(F.col("key") <= F.lit(k)).alias(f"u{i}") for i, k in cuts))
    return wide.select("run_id", F.explode(F.array(*(F.struct(F.lit(i).cast("bigint").alias("split"), F.col(f"l{i}").alias("lower"), F.col(f"u{i}").alias("upper")) for i, _ in cuts))).alias("x")).select("run_id", "x.*")


@query(f"WITH {SPLIT} SELECT part, row_number() OVER (ORDER BY key) AS pos, event_id FROM cl")
def sample_sort(spark, sf_dir):
    """Classified by the splitters, then ranked by range and key: the ranges' own
    number doesn't limit the tasks."""
    return sorting.ranked(classified(spark, sf_dir).select("part", "key", "event_id"), ["part", "key"]).select("part", "pos", "event_id")


@query("SELECT event_id // 2500 AS chunk, event_id - (event_id // 2500) * 2500 AS local, event_id AS global FROM events")
def permutation_compose(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 2500).alias("chunk"), (F.col("event_id") % 2500).alias("local"))
    return e.withColumn("global", F.col("chunk") * 2500 + F.col("local"))


# -- verification ----------------------------------------------------------


@query("SELECT 0::BIGINT AS n_violations, 0::BIGINT AS first_pos")
def verify_sorted_violations(spark, sf_dir):
    return verify.violations(lineitem_ranked(spark, sf_dir), "key", "pos").fillna(0, ["first_pos"])


@query("WITH p AS (SELECT event_id + 1 AS pos, value, lag(value) OVER (ORDER BY event_id) AS prev FROM events) SELECT count(*) AS n_violations, min(pos) AS first_pos FROM p WHERE prev > value")
def verify_first_violation(spark, sf_dir):
    return verify.violations(read(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("pos"), "value"), "value", "pos", 1000)


@query(f"WITH {LK} SELECT count(*) AS n, sum(('0x'||substr(md5(unhex(key)),1,15))::BIGINT)::VARCHAR AS checksum FROM k")
def verify_multiset_checksum(spark, sf_dir):
    return lineitem(spark, sf_dir).agg(F.count("*").alias("n"), verify.checksum(F.col("key")).cast("string").alias("checksum"))


@query()
def verify_fnv_multiset(spark, sf_dir):
    return verify.fnv1a64_sum(lineitem(spark, sf_dir), "key").withColumn("fnv_sum", F.col("fnv_sum").cast("string"))


@query(f"WITH {EK}, d AS (SELECT key, 1 AS d FROM e UNION ALL SELECT key, -1 FROM e WHERE event_id % 100 <> 7) SELECT key, sum(d)::BIGINT AS diff FROM d GROUP BY key HAVING sum(d) <> 0")
def verify_key_multiset_diff(spark, sf_dir):
    e = events(spark, sf_dir)
    return verify.multiset_diff(e, e.filter("event_id % 100 <> 7"), "key").select(h(), "diff")


@query(f"SELECT count(*) AS n, count(*) * {WIDTH} AS n_bytes, (count(*) * {WIDTH}) % {WIDTH} AS remainder FROM lineitem")
def verify_count(spark, sf_dir):
    n = F.sum(F.octet_length("key"))
    return lineitem(spark, sf_dir).agg(F.count("*").alias("n"), n.alias("n_bytes"), (n % WIDTH).alias("remainder"))


# -- generators ------------------------------------------------------------

_H = "((id + 42) * 2654435761) % 4294967296"
_N = 10_000
_SWAP = "CASE WHEN id % 2 = 0 THEN id + 1 ELSE id - 1 END"
_DIST = {
    "random": _H, "sorted": "id", "reverse": f"{_N} - 1 - id", "sequential": "id + 1", "all_duplicates": "42", "nearly_sorted": f"CASE WHEN id % 40 < 2 AND {_SWAP} < {_N} THEN {_SWAP} ELSE id END",
    "few_unique": f"({_H}) % 1000", "pool10": f"({_H}) % 10", "zipf": f"floor({_N}.0 / (({_H}) % {_N} + 1))", "zipf2": f"floor(4294967296.0 / ({_H} + 1))::BIGINT % 10000", "two_distinct": f"CASE WHEN ({_H}) % 2 = 0 THEN 1 ELSE 2 END",
    "alternating": "CASE WHEN id % 2 = 0 THEN 0 ELSE 255 END", "zeros": "0", "ones": "4294967295", "skew": f"CASE WHEN ({_H}) % 10 < 9 THEN 7 ELSE {_H} END",
}


def _generator(dist: str) -> None:
    @query(f"SELECT id, lpad(hex(({_DIST[dist]})::BIGINT), 8, '0') AS key FROM range({_N}) t(id)", f"gen_{dist}")
    def run(spark, sf_dir):
        return generators.records(spark, _N, dist)


for _d in generators.DISTRIBUTIONS:
    _generator(_d)


@query("SELECT id, string_agg(lpad(hex(((((id * 131 + p) + 42) * 2654435761) % 4294967296 // 65536 % 256)::BIGINT), 2, '0'), '' ORDER BY p)||repeat('42', 50) AS key FROM range(10000) t(id), range(16) u(p) GROUP BY id")
def gen_varying_bytes(spark, sf_dir):
    return generators.varying_bytes(spark, 10_000, 66, 16)


@query("SELECT id AS pos, CASE WHEN id % 100 = 0 AND id + 37 < 10000 THEN id + 37 WHEN id % 100 = 37 AND id >= 37 AND (id - 37) % 100 = 0 THEN id - 37 ELSE id END AS src FROM range(10000) t(id)")
def gen_displaced(spark, sf_dir):
    df = spark.range(10_000).withColumnRenamed("id", "pos")
    return df.withColumn("src", generators.displaced(df, "pos", 100, 37, 10_000))


@query("SELECT id AS pos, CASE WHEN id % 20 = 0 AND id + 7 < 10000 THEN id + 7 WHEN id % 20 = 7 THEN id - 7 ELSE id END AS src FROM range(10000) t(id)")
def gen_displaced_5pct(spark, sf_dir):
    df = spark.range(10_000).withColumnRenamed("id", "pos")
    return df.withColumn("src", generators.displaced(df, "pos", 20, 7, 10_000))


@query("SELECT id, string_agg(lpad(hex(((((id * 1009 + p) + 42) * 2654435761) % 4294967296 // 65536 % 256)::BIGINT), 2, '0'), '' ORDER BY p) AS key, repeat('00', 54) AS payload FROM range(2000) t(id), range(66) u(p) GROUP BY id")
def gen_random_normalized(spark, sf_dir):
    """Keys of 66 random bytes, payloads of 54 zero bytes."""
    key, payload = kc.PRESETS["tpch66"]
    return generators.full_records(spark, 2000, key).select("id", F.col("rec").alias("key"), F.lit("00" * payload).alias("payload"))


@query(f"SELECT id, ({_H}) % 65536 AS key FROM range({_N}) t(id)")
def gen_cardinality_64k(spark, sf_dir):
    return generators.of_cardinality(spark, _N, 1 << 16)


@query("SELECT id, string_agg(lpad(hex(((((id * 1009 + p) + 42) * 2654435761) % 4294967296 // 65536 % 256)::BIGINT), 2, '0'), '' ORDER BY p) AS rec FROM range(2000) t(id), range(120) u(p) GROUP BY id")
def gen_full_records(spark, sf_dir):
    return generators.full_records(spark, 2000, 120)


@query("SELECT run_id, count(*) AS n, min(v) AS lo, max(v) AS hi FROM (SELECT id % 4 AS run_id, id + (CASE WHEN id % 4 = 2 THEN 1000000 ELSE 0 END) AS v FROM range(20000) t(id)) GROUP BY run_id")
def gen_shifted_runs(spark, sf_dir):
    r = spark.range(20_000).select((F.col("id") % 4).alias("run_id"), (F.col("id") + F.when(F.col("id") % 4 == 2, 1_000_000).otherwise(0)).alias("v"))
    return r.groupBy("run_id").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))


# -- reports over benchmark results ----------------------------------------

RESULTS = "b AS (SELECT l_linenumber::BIGINT AS num_records, l_returnflag AS distribution, CASE WHEN l_linestatus = 'O' THEN '2way' ELSE 'kway' END AS strategy, l_quantity AS total_ms, l_quantity * 0.25 AS run_gen_ms, l_quantity * 0.5 AS merge_ms, round(l_extendedprice / 100) AS throughput, CASE WHEN l_tax > 0.07 THEN 'FAIL' ELSE 'pass' END AS verify FROM lineitem)"


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem in the shape of benchmark result rows."""
    q = F.col("l_quantity")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").cast("bigint").alias("num_records"), F.col("l_returnflag").alias("distribution"), F.when(F.col("l_linestatus") == "O", "2way").otherwise("kway").alias("strategy"), q.alias("total_ms"), (q * 0.25).alias("run_gen_ms"), (q * 0.5).alias("merge_ms"),
        F.round(F.col("l_extendedprice") / 100).alias("throughput"), F.when(F.col("l_tax") > 0.07, "FAIL").otherwise("pass").alias("verify"),
    )


@query(f"WITH {RESULTS} SELECT count(*) AS n, count(*) FILTER (verify <> 'pass') AS fails, max(throughput) AS best, min(throughput) AS worst, round(avg(throughput), 4) AS mean FROM b")
def report_summary(spark, sf_dir):
    return results(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(F.col("verify") != "pass").alias("fails"), F.max("throughput").alias("best"), F.min("throughput").alias("worst"), F.round(F.avg("throughput"), 4).alias("mean"))


_CSV = f"{RESULTS}, c AS (SELECT num_records, distribution, strategy, total_ms, throughput AS throughput_gbs, num_records / total_ms / 1000 AS throughput_mrec_s, verify FROM b)"


def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows with all columns of a result file, written and read back."""
    r = results(spark, sf_dir).select(F.lit("none").alias("gpu"), "num_records", "distribution", "strategy", "total_ms", "run_gen_ms", "merge_ms", F.col("throughput").alias("throughput_gbs"), (F.col("num_records") / F.col("total_ms") / 1000).alias("throughput_mrec_s"), F.lit(3).alias("merge_passes"), (F.col("throughput") * 6).alias("hbm_traffic_gb"), "verify")
    path = storage.new_path(spark, "results")
    tables.write_results(r, path)
    return tables.read_results(spark, path)


@query(f"WITH {_CSV} SELECT count(*) AS n, count(*) FILTER (verify <> 'pass') AS fails, max(throughput_gbs) AS best, min(throughput_gbs) AS worst, round(avg(throughput_gbs), 4) AS mean, round(max(throughput_mrec_s), 9) AS best_mrec_s, min(total_ms) AS fastest_ms, max(total_ms) AS slowest_ms FROM c")
def report_from_csv(spark, sf_dir):
    g = "throughput_gbs"
    return result_rows(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(F.col("verify") != "pass").alias("fails"), F.max(g).alias("best"), F.min(g).alias("worst"), F.round(F.avg(g), 4).alias("mean"), F.round(F.max("throughput_mrec_s"), 9).alias("best_mrec_s"), F.min("total_ms").alias("fastest_ms"), F.max("total_ms").alias("slowest_ms"))


@query(f"WITH {RESULTS}, l AS (SELECT distribution, strategy, throughput FROM b WHERE num_records = (SELECT max(num_records) FROM b)), t AS (SELECT max(throughput) AS top FROM l) SELECT distribution, strategy, throughput, repeat('#', floor(40 * throughput / top)::BIGINT) AS bar, count(*) AS n FROM l, t GROUP BY ALL")
def report_chart_largest(spark, sf_dir):
    """The rows of the largest size with their bars, equal ones counted."""
    r = results(spark, sf_dir)
    size = r.agg(F.max("num_records").alias("num_records"))
    l = r.join(F.broadcast(size), "num_records").groupBy("distribution", "strategy", "throughput").agg(F.count("*").alias("n"))
    bar = F.expr("repeat('#', cast(floor(40 * throughput / top) as int))").alias("bar")
    return l.crossJoin(F.broadcast(l.agg(F.max("throughput").alias("top")))).select("distribution", "strategy", "throughput", bar, "n")


@query("SELECT o_orderkey, CASE WHEN x >= 1000000 THEN printf('%.0f', x / 1e6)||'M' WHEN x >= 1000 THEN printf('%.0f', x / 1e3)||'K' ELSE x::VARCHAR END AS size FROM (SELECT o_orderkey, (o_orderkey * o_orderkey * 37 % 90000000)::BIGINT AS x FROM orders)")
def human_size(spark, sf_dir):
    n = F.col("o_orderkey") * F.col("o_orderkey") * 37 % 90_000_000
    return read(spark, sf_dir, "orders").select("o_orderkey", costs.human_size(n).alias("size"))


@query(f"WITH {RESULTS} SELECT num_records, distribution, strategy, count(*) AS n, min(printf('CSV,none,%.2f,%d,%d,%d,%.2f,%.2f,%.2f,%.4f,%.2f,%.2f,%.2f,%.1f', num_records / 4, num_records, 7, 3, total_ms * 0.25, total_ms * 0.5, total_ms, throughput / 4, num_records / 2, num_records / 2, num_records::DOUBLE, 4.0)) AS line FROM b GROUP BY ALL")
def csv_line_sink(spark, sf_dir):
    """Printed result lines; the least of each group."""
    n = F.col("num_records")
    cols = {"gpu": F.lit("none"), "total_gb": n / 4, "num_records": n, "num_runs": F.lit(7), "merge_passes": F.lit(3), "run_gen_ms": F.col("run_gen_ms"), "merge_ms": F.col("merge_ms"), "total_ms": F.col("total_ms"), "gb_s": F.col("throughput") / 4, "h2d_gb": n / 2, "d2h_gb": n / 2, "moved_gb": n.cast("double"), "amplification": F.lit(4.0)}
    rows = results(spark, sf_dir).select("distribution", "strategy", *(c.alias(k) for k, c in cols.items()))
    return rows.groupBy("num_records", "distribution", "strategy").agg(F.count("*").alias("n"), F.min(tables.result_line()).alias("line"))


@query(f"WITH {RESULTS} SELECT num_records, min(throughput) AS lo, round(avg(throughput), 4) AS mean, max(throughput) AS hi FROM b GROUP BY num_records")
def report_by_size(spark, sf_dir):
    return results(spark, sf_dir).groupBy("num_records").agg(F.min("throughput").alias("lo"), F.round(F.avg("throughput"), 4).alias("mean"), F.max("throughput").alias("hi"))


@query(f"WITH {RESULTS}, a AS (SELECT num_records, strategy, avg(run_gen_ms) AS r, avg(merge_ms) AS m FROM b GROUP BY ALL) SELECT num_records, strategy, round(r, 4) AS run_gen, round(m, 4) AS merge, round(CASE WHEN r + m > 0 THEN 100 * r / (r + m) ELSE 0 END, 4) AS run_gen_pct FROM a")
def report_phase_breakdown(spark, sf_dir):
    a = results(spark, sf_dir).groupBy("num_records", "strategy").agg(F.avg("run_gen_ms").alias("r"), F.avg("merge_ms").alias("m"))
    return a.select("num_records", "strategy", F.round("r", 4).alias("run_gen"), F.round("m", 4).alias("merge"), F.round(F.when(F.col("r") + F.col("m") > 0, 100 * F.col("r") / (F.col("r") + F.col("m"))).otherwise(0.0), 4).alias("run_gen_pct"))


_PIVOT = f"{RESULTS}, a AS (SELECT num_records, distribution, max(throughput) FILTER (strategy = '2way') AS two, max(throughput) FILTER (strategy = 'kway') AS k FROM b GROUP BY ALL)"


def _pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).groupBy("num_records", "distribution").pivot("strategy", ["2way", "kway"]).agg(F.max("throughput")).withColumnsRenamed({"2way": "two", "kway": "k"})


@query(f"WITH {_PIVOT} SELECT num_records, distribution, two, k, round(k / two, 6) AS speedup FROM a WHERE two IS NOT NULL AND k IS NOT NULL")
def report_strategy_pivot(spark, sf_dir):
    return _pivot(spark, sf_dir).filter("two is not null and k is not null").withColumn("speedup", F.round(F.col("k") / F.col("two"), 6))


@query(f"WITH {_PIVOT} SELECT count(*) AS n, round(avg(k / two), 5) AS mean, round(exp(avg(ln(k / two))), 5) AS geomean FROM a WHERE two > 0 AND k > 0")
def report_strategy_geomean(spark, sf_dir):
    s = F.col("k") / F.col("two")
    return _pivot(spark, sf_dir).filter("two > 0 and k > 0").agg(F.count("*").alias("n"), F.round(F.avg(s), 5).alias("mean"), F.round(F.exp(F.avg(F.log(s))), 5).alias("geomean"))


@query(f"WITH {RESULTS} SELECT distribution, round(avg(throughput) FILTER (strategy = '2way'), 4) AS two, round(avg(throughput) FILTER (strategy = 'kway'), 4) AS k FROM b WHERE num_records = (SELECT max(num_records) FROM b) GROUP BY distribution")
def report_distribution(spark, sf_dir):
    r = results(spark, sf_dir)
    r = r.join(r.agg(F.max("num_records").alias("num_records")), "num_records")
    return r.groupBy("distribution").pivot("strategy", ["2way", "kway"]).agg(F.round(F.avg("throughput"), 4)).withColumnsRenamed({"2way": "two", "kway": "k"})


@query(f"WITH {RESULTS}, a AS (SELECT num_records, round(avg(throughput), 3) AS mean FROM b GROUP BY num_records), t AS (SELECT max(mean) AS top FROM a) SELECT num_records, mean, repeat('#', floor(40 * mean / top)::BIGINT) AS bar FROM a, t")
def report_throughput_chart(spark, sf_dir):
    a = results(spark, sf_dir).groupBy("num_records").agg(F.round(F.avg("throughput"), 3).alias("mean"))
    return a.crossJoin(F.broadcast(a.agg(F.max("mean").alias("top")))).select("num_records", "mean", F.expr("repeat('#', cast(floor(40 * mean / top) as int))").alias("bar"))


@query(f"WITH {RESULTS}, a AS (SELECT num_records, strategy, round(avg(merge_ms * 2 / total_ms), 6) AS amplification FROM b WHERE total_ms > 0 GROUP BY ALL) SELECT * FROM a")
def report_traffic_amplification(spark, sf_dir):
    return results(spark, sf_dir).filter("total_ms > 0").groupBy("num_records", "strategy").agg(F.round(F.avg(F.col("merge_ms") * 2 / F.col("total_ms")), 6).alias("amplification"))


_SORTED = f"{RESULTS}, a AS (SELECT num_records, list_sort(list(total_ms)) AS s, min(total_ms) AS lo, max(total_ms) AS hi, stddev_pop(total_ms) AS sd FROM b GROUP BY num_records)"


@query(f"WITH {_SORTED} SELECT num_records, s[len(s) // 2 + 1] AS median, lo, hi FROM a")
def upper_median(spark, sf_dir):
    """The upper of the two middle values: a frequency table, so that no task
    gathers a group's values."""
    return _middle(spark, sf_dir, F.floor(F.col("n") / 2) + 1).drop("sd")


@query(f"WITH {_SORTED} SELECT num_records, s[(len(s) + 1) // 2] AS median, lo, hi, round(sd, 6) AS sd FROM a")
def lower_median_stddev(spark, sf_dir):
    return _middle(spark, sf_dir, F.floor((F.col("n") + 1) / 2))


def _middle(spark: SparkSession, sf_dir: str, rank) -> DataFrame:
    r = results(spark, sf_dir)
    freq = r.groupBy("num_records", "total_ms").agg(F.count("*").alias("c"))
    upto = sorting.running_sum(freq, ["num_records", "total_ms"], F.col("num_records"), F.col("c"), "upto")
    all_ = r.groupBy("num_records").agg(F.count("*").alias("n"), F.min("total_ms").alias("lo"), F.max("total_ms").alias("hi"), F.round(F.stddev_pop("total_ms"), 6).alias("sd"))
    return upto.join(all_, "num_records").filter((F.col("upto") >= rank) & (F.col("upto") - F.col("c") < rank)).select("num_records", F.col("total_ms").alias("median"), "lo", "hi", "sd")


@query("SELECT event_id, regexp_extract(line, 'time=([0-9.]+)', 1)::DOUBLE AS ms FROM (SELECT event_id, event_type||' time='||value::DECIMAL(10,2)||' ms' AS line FROM events) WHERE starts_with(line, 'click')")
def timing_extraction(spark, sf_dir):
    line = F.concat(F.col("event_type"), F.lit(" time="), F.col("value").cast("decimal(10,2)").cast("string"), F.lit(" ms"))
    logs = read(spark, sf_dir, "events").select("event_id", line.alias("line"))
    return logs.filter(F.col("line").startswith("click")).select("event_id", F.regexp_extract("line", "time=([0-9.]+)", 1).cast("double").alias("ms"))


@query("WITH l AS (SELECT CASE WHEN event_type = 'click' THEN 'CSV,'||event_id||','||value::DECIMAL(10,2) ELSE 'log '||event_id END AS line FROM events) SELECT split_part(line, ',', 2)::BIGINT AS id, split_part(line, ',', 3)::DOUBLE AS v FROM l WHERE line LIKE 'CSV,%'")
def csv_line_filter(spark, sf_dir):
    line = F.when(F.col("event_type") == "click", F.concat_ws(",", F.lit("CSV"), "event_id", F.col("value").cast("decimal(10,2)").cast("string"))).otherwise(F.concat(F.lit("log "), F.col("event_id")))
    lines = read(spark, sf_dir, "events").select(line.alias("line")).filter(F.col("line").startswith("CSV,"))
    return lines.select(F.from_csv("line", F.lit("tag string, id bigint, v double")).alias("x")).select("x.id", "x.v")


# -- cost models -----------------------------------------------------------

_RUNS = "ceil(n / 512.0)"


@query(f"WITH t AS (SELECT count(*) AS n FROM lineitem), f AS (SELECT unnest([2,4,8,16,32]) AS k), p AS (SELECT k, n, greatest(0, ceil(round(ln({_RUNS}) / ln(k), 9)))::BIGINT AS passes FROM t, f), w AS (SELECT *, 2 * n * 100 * passes AS traffic FROM p) SELECT k::BIGINT AS fan_in, passes, traffic, round(traffic / (2039e9 * 0.8) * 1e3, 6) AS ms80, round(traffic / (2039e9 * 0.6) * 1e3, 6) AS ms60, round(traffic / (2039e9 * 0.4) * 1e3, 6) AS ms40 FROM w")
def fan_in_tradeoff(spark, sf_dir):
    n = F.lit(read(spark, sf_dir, "lineitem").count()).cast("bigint")
    k = spark.createDataFrame([(x,) for x in (2, 4, 8, 16, 32)], "fan_in long")
    t = k.withColumn("passes", costs.passes(costs.runs(n), F.col("fan_in"))).withColumn("traffic", costs.traffic(n * 100, F.col("passes")))
    return t.select("fan_in", "passes", "traffic", *(F.round(costs.milliseconds(F.col("traffic"), x / 100), 6).alias(f"ms{x}") for x in (80, 60, 40)))


@query("WITH s AS (SELECT unnest([10,20,50,100,200,500,1000]) AS bytes), r AS (SELECT bytes, 1000000000 // bytes AS n FROM s), p AS (SELECT *, ceil(n / 512.0)::BIGINT AS runs, ceil(round(ln(ceil(n / 512.0)) / ln(2), 9))::BIGINT AS passes2, ceil(round(ln(ceil(n / 512.0)) / ln(8), 9))::BIGINT AS passes8 FROM r) SELECT bytes::BIGINT AS bytes, n::BIGINT AS n, round(10.0 / bytes, 6)::DOUBLE AS key_share, runs, passes2, passes8, 2000000000 * passes2 AS traffic2, 2000000000 * passes8 AS traffic8 FROM p")
def record_size_table(spark, sf_dir):
    total = F.lit(1_000_000_000).cast("bigint")
    s = spark.createDataFrame([(x,) for x in (10, 20, 50, 100, 200, 500, 1000)], "bytes long").withColumn("n", F.floor(total / F.col("bytes")))
    s = s.withColumn("runs", costs.runs(F.col("n"))).withColumn("passes2", costs.passes(F.col("runs"), F.lit(2))).withColumn("passes8", costs.passes(F.col("runs"), F.lit(8)))
    return s.select("bytes", "n", F.round(10.0 / F.col("bytes"), 6).alias("key_share"), "runs", "passes2", "passes8", costs.traffic(total, F.col("passes2")).alias("traffic2"), costs.traffic(total, F.col("passes8")).alias("traffic8"))


@query(f"WITH t AS (SELECT count(*) AS n FROM lineitem), f AS (SELECT unnest([2,4,8,16,32]) AS k) SELECT k::BIGINT AS fan_in, round(n * 120 / 1e9 / (350 / 1e3) + 2 * (n * 120 / 1e9) * greatest(0, ceil(round(ln({_RUNS}) / ln(k), 9))) / (420 / 1e3), 6) AS ms FROM t, f")
def merge_sort_model(spark, sf_dir):
    n = F.lit(read(spark, sf_dir, "lineitem").count())
    k = spark.createDataFrame([(x,) for x in (2, 4, 8, 16, 32)], "fan_in long")
    return k.select("fan_in", F.round(costs.merge_sort_ms(n, F.lit(120), 512, F.col("fan_in"), 350.0, 420.0), 6).alias("ms"))


@query(f"WITH {RESULTS}, a AS (SELECT num_records, 400 / avg(merge_ms) AS ratio FROM b GROUP BY num_records) SELECT num_records, round(ratio, 6) AS ratio, CASE WHEN ratio > 10 THEN 'compute-bound' WHEN ratio > 3 THEN 'partial' ELSE 'near ceiling' END AS kind FROM a")
def bottleneck_class(spark, sf_dir):
    a = results(spark, sf_dir).groupBy("num_records").agg((F.lit(400) / F.avg("merge_ms")).alias("ratio"))
    return a.select("num_records", F.round("ratio", 6).alias("ratio"), F.when(F.col("ratio") > 10, "compute-bound").when(F.col("ratio") > 3, "partial").otherwise("near ceiling").alias("kind"))


# -- sinks and sources: what was written is read back ----------------------


@query(f"WITH {LK} SELECT key FROM k")
def sink_sorted_parquet(spark, sf_dir):
    path = storage.new_path(spark, "sorted")
    sorting.ordered(lineitem(spark, sf_dir).select("key"), ["key"]).write.option("compression", "none").parquet(path)
    return spark.read.parquet(path).select(h())


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_roundtrip(spark, sf_dir):
    path = storage.new_path(spark, "csv")
    df = read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    df.write.option("header", True).csv(path)
    return spark.read.schema(df.schema).option("header", True).csv(path)


@query(f"WITH {EK}, p AS (SELECT row_number() OVER (ORDER BY key) - 1 AS rid, key, lpad(hex(event_id::BIGINT),16,'0') AS payload FROM e) SELECT key, payload FROM p")
def binary_records_roundtrip(spark, sf_dir):
    path = storage.new_path(spark, "records")
    df = sorting.ordered(events(spark, sf_dir).select("key", kc.unsigned("event_id", 8).alias("payload")), ["key"])
    records.write_records(df, path)
    return records.read_records(spark, path, 24, 8).select(h(), h("payload"))


@query("SELECT event_id, user_id FROM events")
def parquet_multi_scan(spark, sf_dir):
    """Three files of one schema read as one table, two columns of them."""
    e, paths = read(spark, sf_dir, "events"), []
    for k in range(3):
        paths.append(storage.new_path(spark, "part"))
        e.filter(F.pmod("user_id", F.lit(3)) == k).write.parquet(paths[-1])
    return tables.read_parquet(spark, paths, ["event_id", "user_id"])


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def arrow_roundtrip(spark, sf_dir):
    return tables.from_arrow(spark, read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").toArrow())


@query("SELECT (n_nationkey // 10)::BIGINT AS chunk, count(*) AS n, min(n_name) AS first, max(n_nationkey)::BIGINT AS last FROM nation GROUP BY 1")
def stream_fetch(spark, sf_dir):
    """A table of bounded size fetched in chunks of ten rows, in order."""
    rows = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"), "n_name").orderBy("k")
    chunks = [(i, len(c), min(r["n_name"] for r in c), max(r["k"] for r in c)) for i, c in enumerate(tables.fetch(rows, 10))]
    return spark.createDataFrame(chunks, "chunk long, n long, first string, last long")
