"""The queries of the linkage engine over the star-schema tables, each with its SQL where SQL can express it."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlink.functions import bits as B
from lumenlink.functions import coins as C
from lumenlink.functions import hashing as H
from lumenlink.functions import text as X
from lumenlink.functions.jrandom import JavaRandom, coefficients, pair_draws
from lumenlink.operators import blocking as K
from lumenlink.operators import encoders as E
from lumenlink.operators import experiment as EX
from lumenlink.operators import hardening as D
from lumenlink.operators import linkage as L
from lumenlink.operators import metrics as M
from lumenlink.operators import numeric as N
from lumenlink.plans import sql as S
from lumenlink.sources import files
from lumenlink.sources import views as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Length of a filter, hash functions, gram length of the shared examples.
BITS, HASHES, Q = 1000, 10, 2
#: Length of a number's vector, and the width of the domain.
M_BITS, WIDTH = 1000, V.HIGH - V.LOW


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _a(spark, d):
    return V.records_a(spark, d)


def _grams(df: DataFrame) -> DataFrame:
    return df.withColumn("grams", X.record_qgrams([F.col("attr1"), F.col("attr2")], Q))


def _clk(df: DataFrame) -> DataFrame:
    return _grams(df).withColumn("bits", E.clk(F.col("grams"), HASHES, BITS))


GRAMS = S.record_grams(["attr1", "attr2"], Q)
SQL_CLK = f"clk AS (SELECT *, list_sort(list_distinct(flatten(list_transform(list_distinct(grams), lambda g: {S.double_hash('g', HASHES, BITS)})))) AS bits FROM (SELECT *, {GRAMS} AS grams FROM rec_a))"
SQL_CLK_B = SQL_CLK.replace("clk AS", "clk_b AS").replace("FROM rec_a", "FROM rec_b")

# ---- sources -------------------------------------------------------------------------------------


@query(f"WITH {V.SQL_A} SELECT entity_id, attr1, attr3 FROM rec_a ORDER BY CAST(entity_id AS BIGINT) LIMIT 500")
def scan_project_limit(spark, d):
    """The first rows of named columns, in the order of the id."""
    return _a(spark, d).orderBy(F.col("entity_id").cast("long")).select("entity_id", "attr1", "attr3").limit(500)


@query("SELECT o_custkey AS entity_id, o_orderkey AS line_no, o_orderstatus AS status FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def dedup_last_wins(spark, d):
    rows = V.table(spark, d, "orders").select(F.col("o_custkey").alias("entity_id"), F.col("o_orderkey").alias("line_no"), F.col("o_orderstatus").alias("status"))
    return files.last_wins(rows.withColumn("at", F.col("line_no")), "entity_id", "at").select("entity_id", "line_no", "status")


_HEIGHT = f"sqrt(-2.0 * ln(1.0 - {S.coin('heights', 'c_custkey', '0', 'radius')})) * cos({2 * math.pi!r} * {S.coin('heights', 'c_custkey', '0', 'angle')}) * 15.0 + 170.0"


@query(f"SELECT id, CASE WHEN v < 140.0 THEN CAST(140.0 AS DOUBLE) ELSE floor(least(v, CAST(200.0 AS DOUBLE))) END AS value FROM (SELECT c_custkey AS id, CAST({_HEIGHT} AS DOUBLE) AS v FROM customer)")
def gen_heights(spark, d):
    rows = V.spread(V.table(spark, d, "customer").select(F.col("c_custkey").alias("id")), "id")
    return N.gaussian_domain(rows, "id", 140, 200)


@query(f"SELECT c_custkey AS id, floor({S.coin('ages', 'c_custkey', '0', 'value')} * 60 + 20) AS value FROM customer")
def gen_ages(spark, d):
    return N.uniform_domain(V.table(spark, d, "customer").select(F.col("c_custkey").alias("id")), "id", 20, 80)


# ---- strings -------------------------------------------------------------------------------------


@query(f"WITH {V.SQL_A} SELECT entity_id, regexp_full_match(attr1, '\\p{{Nd}}*') AS name_numeric, regexp_full_match(attr3, '\\p{{Nd}}*') AS year_numeric, regexp_full_match('', '\\p{{Nd}}*') AS empty_numeric FROM rec_a")
def is_numeric(spark, d):
    return _a(spark, d).select("entity_id", X.is_numeric(F.col("attr1")).alias("name_numeric"), X.is_numeric(F.col("attr3")).alias("year_numeric"), X.is_numeric(F.lit("")).alias("empty_numeric"))


def _gram_query(padded):
    def run(spark, d):
        rows = V.table(spark, d, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), " ")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        return rows.select("word", "n", F.array_join(X.qgrams(F.col("word"), Q, padded), "|").alias("grams"))

    return run


def _gram_sql(padded):
    return f"SELECT word, count(*) AS n, array_to_string({S.grams('word', Q, padded)}, '|') AS grams FROM (SELECT unnest(string_split(coalesce(text, ''), ' ')) AS word FROM documents) GROUP BY word"


@query(_gram_sql(False))
def qgrams(spark, d):
    """Grams of every distinct word of all documents."""
    return _gram_query(False)(spark, d)


@query(_gram_sql(True))
def qgrams_padded(spark, d):
    return _gram_query(True)(spark, d)


@query(f"WITH {V.SQL_A} SELECT entity_id, array_to_string({S.record_grams(['attr1', 'attr2', 'attr3'], Q)}, ' ') AS grams FROM rec_a")
def qgrams_record(spark, d):
    return _a(spark, d).select("entity_id", F.array_join(X.record_qgrams([F.col(c) for c in ("attr1", "attr2", "attr3")], Q), " ").alias("grams"))


_COUNTED = "list_transform(range(1, len(g) + 1), lambda i: g[i] || CAST(len(list_filter(g[1:i], lambda y: y = g[i])) AS VARCHAR))"


@query(f"WITH {V.SQL_A} SELECT entity_id, array_to_string({_COUNTED}, ' ') AS grams FROM (SELECT entity_id, {GRAMS} AS g FROM rec_a)")
def qgrams_counted(spark, d):
    return _grams(_a(spark, d)).select("entity_id", F.array_join(X.counted(F.col("grams")), " ").alias("grams"))


@query(f"WITH {V.SQL_A} SELECT entity_id, array_to_string(list_transform({GRAMS}, lambda g: g || salt), ' ') AS grams FROM rec_a")
def qgrams_salted(spark, d):
    return _grams(_a(spark, d)).select("entity_id", F.array_join(X.salted(F.col("grams"), F.col("salt")), " ").alias("grams"))


@query(f"WITH {V.SQL_A} SELECT entity_id, attr1, {S.soundex('attr1')} AS code1, {S.soundex('attr2')} AS code2, {S.soundex('salt')} AS code3 FROM rec_a")
def soundex_variant(spark, d):
    return _a(spark, d).select("entity_id", "attr1", X.soundex_variant(F.col("attr1")).alias("code1"), X.soundex_variant(F.col("attr2")).alias("code2"), X.soundex_variant(F.col("salt")).alias("code3"))


@query(f"WITH {V.SQL_A} SELECT entity_id, attr1 || ',' || attr2 || ',' AS strings, CAST(attr3 AS INTEGER) AS number, salt || ',' AS places FROM rec_a")
def split_by_type(spark, d):
    df = X.split_by_type(_a(spark, d), ["attr1", "attr2", "attr3", "salt"], ["str", "str", "int", "loc"])
    return df.select("entity_id", X.joined(F.col("str_attrs")).alias("strings"), F.element_at("int_attrs", 1).alias("number"), X.joined(F.col("loc_attrs")).alias("places"))


@query("SELECT p_partkey, bin(p_partkey + p_size) AS total FROM part")
def binary_add(spark, d):
    return V.table(spark, d, "part").select("p_partkey", X.binary_add(F.bin("p_partkey"), F.bin("p_size")).alias("total"))


@query("SELECT p_partkey, bin(p_partkey * p_size) AS product FROM part")
def binary_multiply(spark, d):
    return V.table(spark, d, "part").select("p_partkey", X.binary_multiply(F.bin("p_partkey"), F.col("p_size")).alias("product"))


@query("SELECT p_partkey, right('000000000000000000000000000000' || bin(xor(p_partkey, CAST(p_size AS BIGINT))), 30) AS bits FROM part")
def binary_xor(spark, d):
    wide = lambda c: F.lpad(F.bin(c), 30, "0")
    return V.table(spark, d, "part").select("p_partkey", X.binary_xor(wide("p_partkey"), wide("p_size")).alias("bits"))


@query("SELECT p_partkey, bin(p_partkey % nullif(p_size % 7, 0)) AS rest FROM part")
def binary_mod(spark, d):
    return V.table(spark, d, "part").select("p_partkey", X.binary_mod(F.bin("p_partkey"), F.col("p_size") % 7).alias("rest"))


_GF2 = "list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(1, length(bin(p_partkey)) + 1), lambda i: CAST(substr(bin(p_partkey), i, 1) AS BIGINT))), lambda v, x: CASE WHEN (v << 1 | x) >= 16 THEN xor(v << 1 | x, 19) ELSE v << 1 | x END)"


@query(f"SELECT p_partkey, bin({_GF2}) AS rest FROM part")
def binary_gf2_mod(spark, d):
    """Remainders of the parts' keys as polynomials over GF(2) by x**4 + x + 1."""
    return V.table(spark, d, "part").select("p_partkey", X.gf2_mod(F.bin("p_partkey"), 0b10011).alias("rest"))


# ---- digests and hash families -------------------------------------------------------------------


@query(f"WITH {V.SQL_A} SELECT entity_id, sha1(attr1) AS sha1, md5(attr1) AS md5 FROM rec_a")
def hash_digest(spark, d):
    return _a(spark, d).select("entity_id", H.digest(F.col("attr1")).alias("sha1"), H.digest(F.col("attr1"), "md5").alias("md5"))


@query(f"WITH {V.SQL_A} SELECT entity_id, sha1('key' || attr1) AS sha1, md5('key' || attr1) AS md5 FROM rec_a")
def hash_keyed(spark, d):
    return _a(spark, d).select("entity_id", H.keyed(F.col("attr1"), "key").alias("sha1"), H.keyed(F.col("attr1"), "key", "md5").alias("md5"))


@query(f"WITH {V.SQL_A} SELECT entity_id, {S.hmac('attr1', 'bloomfilter', 'sha1')} AS sha1, {S.hmac('attr1', 'bloomfilter', 'md5')} AS md5 FROM rec_a")
def hash_hmac(spark, d):
    return _a(spark, d).select("entity_id", H.hmac_digest(F.col("attr1"), "bloomfilter").alias("sha1"), H.hmac_digest(F.col("attr1"), "bloomfilter", "md5").alias("md5"))


def _all_grams(spark, d):
    return _grams(_a(spark, d)).select(F.explode("grams").alias("gram")).distinct()


SQL_GRAM = f"gram AS (SELECT DISTINCT unnest({GRAMS}) AS gram FROM rec_a)"


@query(f"WITH {V.SQL_A}, {SQL_GRAM} SELECT gram, {S.shown(S.double_hash('gram', HASHES, BITS))} AS positions FROM gram")
def bf_double_hash(spark, d):
    return _all_grams(spark, d).select("gram", B.shown(H.double_hash(F.col("gram"), HASHES, BITS)).alias("positions"))


_EDH = f"list_transform(range(1, {HASHES + 1}), lambda i: least((({S.low32('sha1(gram)')} + {S.low32('md5(gram)')}) & {H.LOW31}) + (i + 2) * (i + 1) * i * (i - 1) // 24, {H.LOW31}) % {BITS})"


@query(f"WITH {V.SQL_A}, {SQL_GRAM} SELECT gram, {S.shown(_EDH)} AS positions FROM gram")
def bf_enhanced_double_hash(spark, d):
    return _all_grams(spark, d).select("gram", B.shown(H.enhanced_double_hash(F.col("gram"), HASHES, BITS)).alias("positions"))


@query(
    f"""WITH RECURSIVE {V.SQL_A}, {SQL_GRAM},
r AS (
  SELECT gram, 0 AS i, xor({S.low32('sha1(gram)')} & {H.LOW31}, 25214903917) AS v FROM gram
  UNION ALL
  SELECT gram, i + 1, CAST((CAST(v AS HUGEINT) * 25214903917 + 11) % 281474976710656 AS BIGINT) FROM r WHERE i < {HASHES})
SELECT gram, string_agg(CAST((v >> 17) % {BITS} AS VARCHAR), ' ' ORDER BY i) AS positions FROM r WHERE i > 0 GROUP BY gram"""
)
def bf_random_hash(spark, d):
    return _all_grams(spark, d).select("gram", B.shown(H.random_hash(F.col("gram"), HASHES, BITS)).alias("positions"))


SQL_HMAC = f"hm AS (SELECT gram, {S.hmac('gram', 'bloomfilter', 'sha1')} AS s, {S.hmac('gram', 'bloomfilter', 'md5')} AS m FROM gram), hp AS (SELECT gram, {S.big_mod('s', 40, BITS)} AS h1, {S.big_mod('m', 32, BITS)} AS h2 FROM hm)"


def _hmac_positions(k):
    return f"list_transform(range(0, {k}), lambda i: (h1 + i * h2) % {BITS})"


@query(f"WITH {V.SQL_A}, {SQL_GRAM}, {SQL_HMAC} SELECT gram, {S.shown(_hmac_positions(HASHES))} AS positions FROM hp")
def bf_hmac_hash(spark, d):
    return _all_grams(spark, d).select("gram", B.shown(H.hmac_hash(F.col("gram"), HASHES, BITS)).alias("positions"))


# ---- encoders ------------------------------------------------------------------------------------


def _shown(df, bits="bits"):
    return df.select("entity_id", F.size(bits).alias("ones"), B.shown(F.col(bits)).alias("bits"))


def _sql_shown(expr, source, with_):
    return f"WITH {with_} SELECT entity_id, CAST(len(b) AS INTEGER) AS ones, {S.shown('b')} AS bits FROM (SELECT entity_id, {expr} AS b FROM {source})"


WITH_CLK = f"{V.SQL_A}, {SQL_CLK}"


@query(_sql_shown("bits", "clk", WITH_CLK))
def clk_encode(spark, d):
    return _shown(_clk(_a(spark, d)))


@query(_sql_shown("bits", "clk", f"{V.SQL_A}, {SQL_CLK.replace(f'{GRAMS} AS grams', f'list_transform({GRAMS}, lambda s: s || salt) AS grams')}"))
def clk_salted(spark, d):
    return _shown(_grams(_a(spark, d)).withColumn("bits", E.clk(X.salted(F.col("grams"), F.col("salt")), HASHES, BITS)))


_HALF = BITS // 2
_INVERSE = [0] * BITS
for _i, _p in enumerate(JavaRandom(42).permutation(BITS)):
    _INVERSE[_p] = _i


def _rbf_bits(salt: str) -> str:
    part = lambda a, c: f"list_transform(flatten(list_transform(list_distinct({S.grams(c, Q)}), lambda s: {S.double_hash(f'(s{salt})', HASHES, _HALF)})), lambda p: p + {a * _HALF})"
    both = f"list_concat({part(0, 'attr1')}, {part(1, 'attr2')})"
    return f"list_sort(list_distinct(list_transform({both}, lambda p: {S.listed(_INVERSE)}[p + 1])))"


def _rbf_sql(salt: str):
    return _sql_shown(_rbf_bits(salt), "rec_a", V.SQL_A)


def _rbf(spark, d, salt):
    g = [X.qgrams(F.col(c), Q) for c in ("attr1", "attr2")]
    g = [X.salted(x, F.col("salt")) for x in g] if salt else g
    return _shown(_a(spark, d).withColumn("bits", E.rbf(g, HASHES, BITS)))


@query(_rbf_sql(""))
def rbf_encode(spark, d):
    return _rbf(spark, d, False)


@query(_rbf_sql(" || salt"))
def rbf_salted(spark, d):
    return _rbf(spark, d, True)


BF_K = 30
SQL_BF = f"{SQL_GRAM}, {SQL_HMAC}, bf AS (SELECT entity_id, list_sort(list_distinct(flatten(list({_hmac_positions(BF_K)})))) AS bits FROM (SELECT entity_id, unnest(list_distinct({GRAMS})) AS gram FROM rec_a) JOIN hp USING (gram) GROUP BY entity_id)"


def _bf(spark, d):
    return _grams(_a(spark, d)).withColumn("bits", E.clk(F.col("grams"), BF_K, BITS, "hmac"))


@query(_sql_shown("bits", "bf", f"{V.SQL_A}, {SQL_BF}"))
def bf_encode_normal(spark, d):
    return _shown(_bf(spark, d))


def _uldp_sql(bits, seed="coins"):
    return f"list_filter(range(0, {BITS}), lambda p: list_contains({bits}, p) OR {S.coin(seed, 'entity_id', 'p', 'response')} < {math.exp(-1)!r})"


def _wxor_sql(bits):
    circle = S.odd(f"list_concat({bits}, list_transform({bits}, lambda p: (p + {BITS - 1}) % {BITS}))")
    return f"CASE WHEN NOT list_contains({bits}, 1) THEN {circle} WHEN list_contains({circle}, {BITS - 1}) THEN list_filter({circle}, lambda p: p <> {BITS - 1}) ELSE list_append({circle}, {BITS - 1}) END"


def _resample_sql(bits):
    one, two = zip(*pair_draws(BITS), strict=True)
    return f"list_filter(range(0, {BITS}), lambda i: list_contains({bits}, {S.listed(one)}[i + 1]) <> list_contains({bits}, {S.listed(two)}[i + 1]))"


@query(_sql_shown(_uldp_sql("bits"), "bf", f"{V.SQL_A}, {SQL_BF}"))
def bf_encode_uldp(spark, d):
    return _shown(_bf(spark, d).withColumn("bits", D.uldp(F.col("bits"), BITS, F.col("entity_id"))))


@query(_sql_shown(_wxor_sql("bits"), "bf", f"{V.SQL_A}, {SQL_BF}"))
def bf_encode_wxor(spark, d):
    return _shown(_bf(spark, d).withColumn("bits", D.wxor(F.col("bits"), BITS)))


@query(_sql_shown(_resample_sql("bits"), "bf", f"{V.SQL_A}, {SQL_BF}"))
def bf_encode_resam(spark, d):
    return _shown(_bf(spark, d).withColumn("bits", D.resample_xor(F.col("bits"), BITS)))


_SIZES = f"SELECT len({GRAMS}) AS s FROM rec_a UNION ALL SELECT len({GRAMS}) FROM rec_b"


@query(f"WITH {V.SQL_B} SELECT CAST(floor(CAST({math.log(2)!r} AS DOUBLE) * {BITS} / avg(s) + 0.5) AS BIGINT) AS k FROM ({_SIZES})")
def optimal_k(spark, d):
    return E.optimal_k(_grams(_a(spark, d)), _grams(V.records_b(spark, d)), "grams", BITS)


# ---- hardening -----------------------------------------------------------------------------------


def _hardened(config):
    def run(spark, d):
        df, _ = D.harden(_clk(_a(spark, d)), "bits", BITS, "entity_id", config)
        return _shown(df, "hardened")

    return run


_BAL = [0] * (2 * BITS)
for _i, _p in enumerate(JavaRandom(42).permutation(2 * BITS)):
    _BAL[_p] = _i


@query(_sql_shown(f"list_sort(list_transform(list_concat(bits, list_transform(list_filter(range(0, {BITS}), lambda p: NOT list_contains(bits, p)), lambda p: p + {BITS})), lambda p: {S.listed(_BAL)}[p + 1]))", "clk", WITH_CLK))
def harden_balance(spark, d):
    return _hardened("bal")(spark, d)


@query(_sql_shown(S.odd(f"list_transform(bits, lambda p: p % {BITS // 2})"), "clk", WITH_CLK))
def harden_xorfold(spark, d):
    return _hardened("xor")(spark, d)


@query(_sql_shown(S.odd(f"list_concat(list_transform(bits, lambda p: (p + 1) % {BITS}), list_transform(bits, lambda p: (p + {BITS - 1}) % {BITS}))"), "clk", WITH_CLK))
def harden_rule90(spark, d):
    return _hardened("r90")(spark, d)


@query(_sql_shown(_wxor_sql("bits"), "clk", WITH_CLK))
def harden_wxor(spark, d):
    return _hardened("wxor-1")(spark, d)


@query(_sql_shown(_resample_sql("bits"), "clk", WITH_CLK))
def harden_resample_xor(spark, d):
    return _hardened("rexor")(spark, d)


@query(_sql_shown(_uldp_sql("bits"), "clk", WITH_CLK))
def harden_uldp(spark, d):
    return _hardened("uldp-1")(spark, d)


def _blip_sql(prob, was="list_contains(bits, p)"):
    return f"(CASE WHEN {S.coin('coins', 'entity_id', 'p', 'replace')} < {prob} THEN {S.coin('coins', 'entity_id', 'p', 'fair')} < 0.5 ELSE {was} END)"


@query(_sql_shown(f"list_filter(range(0, {BITS}), lambda p: {_blip_sql(0.1)})", "clk", WITH_CLK))
def harden_blip(spark, d):
    return _hardened("blip-0.1")(spark, d)


SQL_FREQ = f"freq AS (SELECT CAST(r.bit AS INTEGER) AS bit, CAST(coalesce(f.freq, 0) AS BIGINT) AS freq FROM (SELECT unnest(range(0, {BITS})) AS bit) r LEFT JOIN (SELECT bit, count(*) AS freq FROM (SELECT unnest(bits) AS bit FROM clk) GROUP BY bit) f ON r.bit = f.bit)"
RATIO = 0.5
SQL_SECRET = f"secret AS (SELECT bit, freq, row_number() OVER (ORDER BY freq, bit DESC) > {int(math.floor(RATIO * BITS + 0.5))} AS secret FROM freq)"
SQL_PLAIN = "plain AS (SELECT list(bit) AS plain FROM secret WHERE NOT secret)"


@query(f"WITH {WITH_CLK}, {SQL_FREQ} SELECT * FROM freq")
def bit_frequency(spark, d):
    return D.bit_frequency(_clk(_a(spark, d)), "bits", BITS)


@query(f"WITH {WITH_CLK}, {SQL_FREQ}, {SQL_SECRET} SELECT * FROM secret")
def urap_secret_split(spark, d):
    return D.secret_split(D.bit_frequency(_clk(_a(spark, d)), "bits", BITS), BITS, RATIO)


_THETA, _D1, _D2 = D.urap_parameters(1.0)
_URAP = f"list_filter(range(0, {BITS}), lambda p: CASE WHEN list_contains(plain, p) THEN list_contains(bits, p) AND {S.coin('coins', 'entity_id', 'p', 'response')} < {1 - _D2!r} ELSE {S.coin('coins', 'entity_id', 'p', 'response')} < (CASE WHEN list_contains(bits, p) THEN {_THETA!r} ELSE {_D1!r} END) END)"


@query(_sql_shown(_URAP, "clk, plain", f"{WITH_CLK}, {SQL_FREQ}, {SQL_SECRET}, {SQL_PLAIN}"))
def harden_urap(spark, d):
    return _hardened("urap-0.5-1")(spark, d)


_URAP_PROB = f"list_filter(range(0, {BITS}), lambda p: CASE WHEN list_contains(plain, p) THEN list_contains(bits, p) AND {_blip_sql(0.3)} ELSE {_blip_sql(0.6)} END)"


@query(_sql_shown(_URAP_PROB, "clk, plain", f"{WITH_CLK}, {SQL_FREQ}, {SQL_SECRET}, {SQL_PLAIN}"))
def harden_urap_prob(spark, d):
    return _shown(D.urap_prob(_clk(_a(spark, d)), "bits", BITS, "entity_id", RATIO, 0.6, 0.3), "hardened")


PROBS = [0.1, 0.2, 0.4]
_SIZE = BITS // len(PROBS)
SQL_GROUP = f"grp AS (SELECT bit, freq, CAST(CASE WHEN r < {_SIZE * len(PROBS)} THEN r // {_SIZE} END AS INTEGER) AS grp FROM (SELECT *, row_number() OVER (ORDER BY freq, bit) - 1 AS r FROM freq)), probs AS (SELECT list(coalesce({S.listed(PROBS)}[grp + 1], 0.0) ORDER BY bit) AS probs FROM grp)"


@query(f"WITH {WITH_CLK}, {SQL_FREQ}, {SQL_GROUP} SELECT * FROM grp")
def indexd_groups(spark, d):
    return D.frequency_groups(D.bit_frequency(_clk(_a(spark, d)), "bits", BITS), BITS, len(PROBS))


@query(_sql_shown(f"list_filter(range(0, {BITS}), lambda p: {_blip_sql('probs[p + 1]')})", "clk, probs", f"{WITH_CLK}, {SQL_FREQ}, {SQL_GROUP}"))
def harden_indexd(spark, d):
    return _hardened("indexD-0.1-0.2-0.4")(spark, d)


_ORDER = JavaRandom(42).permutation(BITS)
_PAIRS = [(min(a, b), max(a, b)) for a, b in zip(_ORDER[::2], _ORDER[1::2], strict=True)][: int(BITS * 0.2)]


@query(
    f"""WITH {WITH_CLK}, dropped AS (
  SELECT entity_id, bits, list_transform({S.listed(_PAIRS)}, lambda x: CASE WHEN list_contains(bits, x[2]) AND NOT list_contains(bits, x[1]) THEN x[1] ELSE x[2] END) AS dr FROM clk)
SELECT entity_id, CAST(len(b) AS INTEGER) AS ones, {S.shown('b')} AS bits
FROM (SELECT entity_id, list_transform(list_filter(bits, lambda p: NOT list_contains(dr, p)), lambda p: p - len(list_filter(dr, lambda x: x < p))) AS b FROM dropped)"""
)
def compress_bits(spark, d):
    return _shown(_clk(_a(spark, d)).withColumn("hardened", D.compress(F.col("bits"), BITS, 0.2)), "hardened")


# ---- numbers -------------------------------------------------------------------------------------

SHARED = N.thresholds(M_BITS, V.LOW, V.HIGH)
_TBITS = f"list_filter(range(0, {M_BITS}), lambda i: value >= {S.listed(SHARED)}[i + 1])"
_NUM = f"{V.SQL_N}, enc AS (SELECT id, value, {_TBITS} AS bits FROM num)"


def _numbers(spark, d):
    return V.numbers(spark, d).withColumn("bits", N.threshold_bits(F.col("value"), SHARED))


def _num_shown(df):
    return df.select("id", F.size("bits").alias("ones"), B.shown(F.col("bits")).alias("bits"))


def _num_sql(expr):
    return f"WITH {_NUM} SELECT id, CAST(len(b) AS INTEGER) AS ones, {S.shown('b')} AS bits FROM (SELECT id, {expr} AS b FROM enc)"


def _flip_sql(flip):
    return f"list_filter(range(0, {M_BITS}), lambda p: list_contains(bits, p) <> ({flip}))"


_DPRL = _flip_sql(f"{S.coin('numbers', 'id', 'p', 'first')} > 0.8 AND {S.coin('numbers', 'id', 'p', 'second')} > 0.5")
_RESPOND = f"{S.coin('numbers', 'id', 'p', 'response')} < {N.flip_probability()!r}"
_V1 = _flip_sql(f"(p // 10) * 10 + CAST(floor({S.coin('numbers', 'id', '((p // 10) * 10)', 'pick')} * least(10, {M_BITS} - (p // 10) * 10)) AS BIGINT) = p AND {_RESPOND}")
_V2 = _flip_sql(f"{S.listed(N.shared_picks(M_BITS))}[p // 10 + 1] = p AND {_RESPOND}")
_V3 = f"list_filter(range(0, {M_BITS}), lambda p: list_contains(bits, p) OR {S.coin('numbers', 'id', 'p', 'response')} < {math.exp(-1)!r})"
_UE = f"list_filter(range(0, {int(WIDTH) + 1}), lambda p: p = greatest(0, floor((value - {V.LOW}) / 1.0) + 1) OR {S.coin('numbers', 'id', 'p', 'response')} < {math.exp(-1)!r})"
NOISE = {"dprl": N.noise_dprl, "v1": N.noise_v1, "v2": N.noise_v2, "v3": N.noise_v3}


def _noisy(spark, d, method):
    return _numbers(spark, d).withColumn("bits", NOISE[method](F.col("bits"), M_BITS, F.col("id")))


def _ue(spark, d):
    return V.numbers(spark, d).withColumn("bits", N.ue_bits(F.col("value"), V.LOW, V.HIGH, F.col("id")))


@query(_num_sql("bits"))
def num_encode_threshold(spark, d):
    return _num_shown(_numbers(spark, d))


@query(_num_sql(_DPRL))
def num_encode_dprl(spark, d):
    return _num_shown(_noisy(spark, d, "dprl"))


@query(_num_sql(_V1))
def num_encode_v1(spark, d):
    return _num_shown(_noisy(spark, d, "v1"))


@query(_num_sql(_V2))
def num_encode_v2(spark, d):
    return _num_shown(_noisy(spark, d, "v2"))


@query(_num_sql(_V3))
def num_encode_v3(spark, d):
    return _num_shown(_noisy(spark, d, "v3"))


@query(_num_sql(_UE))
def num_encode_ue(spark, d):
    return _num_shown(_ue(spark, d))


def _pairs(df: DataFrame, extra: dict, n: int = M_BITS) -> DataFrame:
    """All pairs with the true distance, the Hamming distance of the vectors, more columns of both sides, and how many pairs of records they are."""
    packed = df.select("id", "value", C.word_columns(F.col("bits"), n).alias("w"), *(c.alias(k) for k, c in extra.items()))
    p = N.all_pairs(packed, "id", ["value", "w", *extra])
    h = B.hamming(*([F.get(f"w_{s}", k) for k in range(-(-n // 64))] for s in "ab"))
    return p.withColumn("true_dis", F.abs(F.col("value_a") - F.col("value_b"))).withColumn("h", h)


def _summary(df: DataFrame, estimate, limits=(), x=None, bits: str | None = "bits") -> DataFrame:
    """Ends without limits, else counts; every estimate here rises with the Hamming distance."""
    return N.distances(df if x is None else df.withColumn("x", x), "value", bits, M_BITS, estimate, limits, None if x is None else "x", ends=not limits, rising=True)


def _ends(summary: DataFrame) -> DataFrame:
    """As ``_by_distance``, from partial sums."""
    return summary.groupBy("true_dis").agg(F.sum("n").alias("n"), F.round(F.min("least"), 6).alias("least"), F.round(F.max("most"), 6).alias("most"))


def _by_distance(pairs: DataFrame, est) -> DataFrame:
    """For each true distance: pairs, least and largest estimate."""
    return pairs.select("true_dis", "pairs", est.alias("est")).groupBy("true_dis").agg(F.sum("pairs").alias("n"), F.round(F.min("est"), 6).alias("least"), F.round(F.max("est"), 6).alias("most"))


def _est_sql(bits: str, est: str, extra: str = "", n: int = M_BITS, tail: str | None = None) -> str:
    """``est`` is over h, and a., b. columns of both sides."""
    tail = tail or "SELECT true_dis, count(*) AS n, round(min(est), 6) AS least, round(max(est), 6) AS most FROM pairs GROUP BY true_dis"
    return f"""WITH {_NUM}, noisy AS (SELECT id, value, {bits} AS bits FROM enc), packed AS (SELECT id, value, {S.bit_string('bits', n)} AS v{extra} FROM noisy),
met AS (SELECT a.value AS va, b.value AS vb, CAST(bit_count(xor(a.v, b.v)) AS DOUBLE) AS h{", a.x AS xa, b.x AS xb" if extra else ""} FROM packed a JOIN packed b ON a.id < b.id),
pairs AS (SELECT abs(va - vb) AS true_dis, {est} AS est FROM met)
{tail}"""


@query(_est_sql("bits", "h"))
def hamming_distance(spark, d):
    return _by_distance(_pairs(_numbers(spark, d), {}), F.col("h").cast("double"))


_PLAIN = f"h / 1.1 * {WIDTH} / {M_BITS}"


@query(_est_sql("bits", _PLAIN))
def est_distance_plain(spark, d):
    p = _pairs(_numbers(spark, d), {})
    return _by_distance(p, N.est_plain(F.col("h"), M_BITS, WIDTH))


@query(_est_sql("bits", _PLAIN, tail="SELECT true_dis, CAST(est <= true_dis AS BOOLEAN) AS below, count(*) AS n FROM pairs GROUP BY 1, 2"))
def pairs_distance(spark, d):
    """All pairs: how often the plain estimate falls below the true distance."""
    p = _pairs(_numbers(spark, d), {}).withColumn("est", N.est_plain(F.col("h"), M_BITS, WIDTH))
    return p.groupBy("true_dis", (F.col("est") <= F.col("true_dis")).alias("below")).agg(F.sum("pairs").alias("n"))


_EST_DPRL = f"(h / 1.1 / {M_BITS} - {(1 - 0.8 * 0.8) / 2!r}) * {WIDTH} / {0.8 * 0.8!r}"


def _dprl_estimate(width):
    return lambda h, a, b: N.est_dprl(h, M_BITS, width)


def _segment_estimate(method):
    return lambda h, a, b: N.est_segments(h, M_BITS, WIDTH, method)


@query(_est_sql(_DPRL, _EST_DPRL))
def est_distance_dprl(spark, d):
    return _ends(_summary(_noisy(spark, d, "dprl"), _dprl_estimate(WIDTH)))


def _segment_sql(method):
    noise, slope = N.segment_terms(M_BITS, method)
    return f"(h / 1.1 - {noise!r}) * {WIDTH} / {slope!r}"


@query(_est_sql(_V1, _segment_sql("v1")))
def est_distance_v1(spark, d):
    return _ends(_summary(_noisy(spark, d, "v1"), _segment_estimate("v1")))


@query(_est_sql(_V2, _segment_sql("v2")))
def est_distance_v2(spark, d):
    return _ends(_summary(_noisy(spark, d, "v2"), _segment_estimate("v2")))


_P = math.exp(-1.0)
_VALUE = f"(CAST(len(bits) AS DOUBLE) / {M_BITS} * {WIDTH} - {V.HIGH} * {_P!r} + {V.LOW}) / {1 - _P!r}"
_EST_V3 = f"h / 1.1 * {WIDTH} / {M_BITS} / {1 - _P!r} - ({V.HIGH} - greatest(xa, xb)) * {2 * _P!r}"


def _v3_summary(spark, d, limits=()):
    x = N.est_value(F.size("bits"), M_BITS, V.LOW, V.HIGH)
    return _summary(_noisy(spark, d, "v3"), lambda h, a, b: N.est_v3(h, a, b, M_BITS, V.LOW, V.HIGH), limits, x)


@query(_est_sql(_V3, _EST_V3, f", {_VALUE} AS x"))
def est_distance_v3(spark, d):
    return _ends(_v3_summary(spark, d))


@query(f"WITH {_NUM} SELECT id, value, round({_VALUE}, 9) AS estimate FROM (SELECT id, value, {_V3} AS bits FROM enc)")
def est_value(spark, d):
    return _noisy(spark, d, "v3").select("id", "value", F.round(N.est_value(F.size("bits"), M_BITS, V.LOW, V.HIGH), 9).alias("estimate"))


_UE_SUM = f"coalesce(list_sum(list_transform(bits, lambda p: CAST(p + {V.LOW} AS DOUBLE))), 0.0)"


@query(_est_sql(_UE, f"abs(xa - xb) / {1 - _P!r}", f", {_UE_SUM} AS x", int(WIDTH) + 1))
def est_distance_ue(spark, d):
    return _ends(_summary(_ue(spark, d), lambda h, a, b: N.est_ue(a, b), x=N.ue_sum(F.col("bits"), V.LOW), bits=None))


_PRF = """SELECT count(*) FILTER (est <= {t} AND true_dis <= {t}) AS tp, count(*) FILTER (est <= {t} AND true_dis > {t}) AS fp, count(*) FILTER (est > {t} AND true_dis > {t}) AS tn, count(*) FILTER (est > {t} AND true_dis <= {t}) AS fn FROM pairs"""
_RATIOS = "tp, fp, tn, fn, round(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 9) AS \"precision\", round(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 9) AS recall, round(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 9) AS f1"


@query(_est_sql(_DPRL, _EST_DPRL, tail=f"SELECT {_RATIOS} FROM ({_PRF.format(t=5.0)})"))
def prf_distance(spark, d):
    return M.prf_distance(N.decided(_summary(_noisy(spark, d, "dprl"), _dprl_estimate(WIDTH), (5.0,)), (5.0,)), 5.0)


@query(_est_sql(_V3, _EST_V3, f", {_VALUE} AS x", tail=f"SELECT {_RATIOS} FROM ({_PRF.format(t=5.0)})"))
def prf_distance_v3(spark, d):
    return M.prf_distance(N.decided(_v3_summary(spark, d, (5.0,)), (5.0,)), 5.0)


@query(f"WITH {V.SQL_N} SELECT CAST(least(floor((value - {V.LOW}) / {WIDTH / 60!r}), 59) AS INTEGER) AS bin, count(*) AS n FROM num WHERE value BETWEEN {V.LOW} AND {V.HIGH} GROUP BY 1")
def histogram(spark, d):
    return M.histogram(V.numbers(spark, d), "value", V.LOW, V.HIGH)


# ---- blocking ------------------------------------------------------------------------------------


def _blocks(df, keys):
    return K.blocks(df, keys)


@query(f"WITH {V.SQL_A} SELECT entity_id, 'all' AS block_key FROM rec_a")
def block_none(spark, d):
    return _blocks(_a(spark, d), F.array(K.none_key()))


@query(f"WITH {V.SQL_A} SELECT entity_id, {S.soundex('attr2')} AS block_key FROM rec_a")
def block_soundex(spark, d):
    return _blocks(_a(spark, d), F.array(K.soundex_key(F.col("attr2"))))


SAMPLES = K.sampled_positions(30, 16, BITS)
_RANDOM = f"list_transform(range(0, 30), lambda k: CAST(k AS VARCHAR) || ':' || array_to_string(list_transform({S.listed(SAMPLES)}[k + 1], lambda p: CASE WHEN list_contains(bits, p) THEN '1' ELSE '0' END), ''))"


@query(f"WITH {WITH_CLK} SELECT DISTINCT entity_id, unnest({_RANDOM}) AS block_key FROM clk")
def block_hlsh_random(spark, d):
    return _blocks(_clk(_a(spark, d)), K.hlsh_random_keys(F.col("bits"), SAMPLES))


SEGMENTS = 50
_SEGMENT = f"list_transform(range(0, {SEGMENTS}), lambda k: CAST(k AS VARCHAR) || ':' || array_to_string(list_filter(bits, lambda p: p // {BITS // SEGMENTS} = k), ','))"


@query(f"WITH {WITH_CLK} SELECT DISTINCT entity_id, unnest({_SEGMENT}) AS block_key FROM clk")
def block_hlsh_segment(spark, d):
    return _blocks(_clk(_a(spark, d)), K.hlsh_segment_keys(F.col("bits"), BITS, SEGMENTS))


BANDS, ROWS = 32, 5


@query("SELECT CAST(i / 10.0 AS DOUBLE) AS similarity, round(pow(1.0 / 32, 1.0 / 5), 9) AS threshold, round(1 - pow(1 - pow(i / 10.0, 5), 32), 9) AS chance FROM (SELECT unnest(range(0, 10)) AS i)")
def minhash_scurve(spark, d):
    t, points = K.s_curve(BANDS, ROWS)
    return spark.createDataFrame([(s, round(t, 9), round(p, 9)) for s, p in points], "similarity double, threshold double, chance double")


_CA, _CB = coefficients(BANDS * ROWS)
_SIG = f"(CASE WHEN len(grams) > 0 THEN list_transform(range(1, {BANDS * ROWS + 1}), lambda f: list_min(list_transform(list_distinct(grams), lambda g: ({S.listed(_CA)}[f] * {S.low32('md5(g)')} + {S.listed(_CB)}[f]) % {K.PRIME}))) END)"
_BAND = f"list_transform(range(0, {BANDS}), lambda k: CAST(k AS VARCHAR) || ':' || md5(array_to_string(sig[k * {ROWS} + 1 : k * {ROWS} + {ROWS}], ',')))"


def _minhash_sql(of, alias, sig=_SIG):
    return f"{alias} AS (SELECT DISTINCT entity_id, unnest({_BAND}) AS block_key FROM (SELECT entity_id, {sig} AS sig FROM {of}) WHERE sig IS NOT NULL)"


#: As the signature over md5, with crc32 of the grams, which are ASCII here.
_SIG_CRC = f"(CASE WHEN len(grams) > 0 THEN list_transform(range(1, {BANDS * ROWS + 1}), lambda f: list_min(list_transform(list_distinct(grams), lambda g: ({S.listed(_CA)}[f] * {S.crc32('g')} + {S.listed(_CB)}[f]) % {K.PRIME}))) END)"


@query(f"WITH {WITH_CLK} SELECT entity_id, array_to_string({_SIG_CRC}, ' ') AS signature FROM clk")
def minhash_signature(spark, d):
    return _grams(_a(spark, d)).select("entity_id", B.shown(K.minhash(F.col("grams"), BANDS * ROWS)).alias("signature"))


@query(f"WITH {WITH_CLK} SELECT entity_id, array_to_string({_SIG}, ' ') AS signature FROM clk")
def minhash_signature_md5(spark, d):
    """The signature over another base hash, which SQL has too."""
    return _grams(_a(spark, d)).select("entity_id", B.shown(K.minhash(F.col("grams"), BANDS * ROWS, "md5")).alias("signature"))


def _minhash_blocks(df, base):
    return _blocks(_grams(df), K.band_keys(K.minhash(F.col("grams"), BANDS * ROWS, base), BANDS, ROWS))


@query(f"WITH {WITH_CLK}, {_minhash_sql('clk', 'blk', _SIG_CRC)} SELECT * FROM blk")
def block_minhash(spark, d):
    return _minhash_blocks(_a(spark, d), "crc32")


@query(f"WITH {WITH_CLK}, {_minhash_sql('clk', 'blk')} SELECT * FROM blk")
def block_minhash_md5(spark, d):
    return _minhash_blocks(_a(spark, d), "md5")


@query(f"WITH {V.SQL_A}, s AS (SELECT {S.soundex('attr2')} AS k, count(*) AS n FROM rec_a GROUP BY 1) SELECT count(*) AS n_blocks, min(n) AS min_size, round(avg(n), 6) AS avg_size, max(n) AS max_size, count(*) FILTER (n = 1) AS n_single, count(*) FILTER (n > 100) AS n_large FROM s")
def block_stats(spark, d):
    return K.block_stats(block_soundex(spark, d))


# ---- linkage -------------------------------------------------------------------------------------

SQL_SX = f"sx_a AS (SELECT *, {S.soundex('attr2')} AS block_key FROM rec_a), sx_b AS (SELECT *, {S.soundex('attr2')} AS block_key FROM rec_b)"


def _soundex(df):
    return _blocks(df, F.array(K.soundex_key(F.col("attr2"))))


def _b(spark, d):
    return V.records_b(spark, d)


@query(f"WITH {V.SQL_B}, {SQL_SX} SELECT block_key, n_left, n_right FROM (SELECT block_key, count(*) AS n_left FROM sx_a GROUP BY 1) JOIN (SELECT block_key, count(*) AS n_right FROM sx_b GROUP BY 1) USING (block_key)")
def shared_blocks(spark, d):
    return L.shared_blocks(_soundex(_a(spark, d)), _soundex(_b(spark, d)))


_SETDICE = "2.0::DOUBLE * len(list_intersect(list_distinct(a.grams), list_distinct(b.grams))) / nullif(len(list_distinct(a.grams)) + len(list_distinct(b.grams)), 0)"
_SX_PAIRS = f"ga AS (SELECT *, {GRAMS} AS grams FROM sx_a), gb AS (SELECT *, {GRAMS} AS grams FROM sx_b), lq AS (SELECT a.entity_id AS entity_a, b.entity_id AS entity_b, {_SETDICE} AS sim FROM ga a JOIN gb b USING (block_key))"
_LINKED = f"WITH {V.SQL_B}, {SQL_SX}, {_SX_PAIRS}"


def _link(spark, d):
    a, b = _a(spark, d), _b(spark, d)
    return L.link_grams(_grams(a), _grams(b), _soundex(a), _soundex(b), 0.5)


@query(f"{_LINKED} SELECT * FROM lq WHERE sim >= 0.5")
def link_qgram(spark, d):
    """Records of both sets that share a phonetic block, with the Dice similarity of their grams."""
    return _link(spark, d)


@query(f"{_LINKED} SELECT entity_a, entity_b, sim FROM lq")
def sim_dice_qgram(spark, d):
    a, b = _a(spark, d), _b(spark, d)
    return L.link_grams(_grams(a), _grams(b), _soundex(a), _soundex(b), 0.0)


@query(f"{_LINKED} SELECT a.entity_id AS entity_a, b.entity_id AS entity_b, 2.0::DOUBLE * len(list_filter(b.grams, lambda x: list_contains(a.grams, x))) / nullif(len(a.grams) + len(b.grams), 0) AS sim FROM ga a JOIN gb b USING (block_key)")
def sim_dice_bag(spark, d):
    a, b = _grams(_a(spark, d)), _grams(_b(spark, d))
    pairs = L.candidates(_soundex(a), _soundex(b))
    left, right = a.select(F.col("entity_id").alias("entity_a"), F.col("grams").alias("ga")), b.select(F.col("entity_id").alias("entity_b"), F.col("grams").alias("gb"))
    return pairs.join(left, "entity_a").join(right, "entity_b").select("entity_a", "entity_b", L.dice_bag(F.col("ga"), F.col("gb")).alias("sim"))


def _bit_dice(a, b):
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect({a}, {b})) / (len({a}) + len({b})) END"


_BOTH_CLK = f"WITH {V.SQL_B}, {SQL_SX}, {SQL_CLK}, {SQL_CLK_B}"
_CANDS = "cand AS (SELECT DISTINCT a.entity_id AS entity_a, b.entity_id AS entity_b FROM sx_a a JOIN sx_b b USING (block_key))"
_BITPAIRS = f"SELECT entity_a, entity_b, {_bit_dice('x.bits', 'y.bits')} AS sim FROM cand JOIN clk x ON x.entity_id = entity_a JOIN clk_b y ON y.entity_id = entity_b"


@query(f"{_BOTH_CLK}, {_CANDS} {_BITPAIRS}")
def sim_dice_bits(spark, d):
    a, b = _a(spark, d), _b(spark, d)
    return L.link_bits(_clk(a), _clk(b), _soundex(a), _soundex(b), "bits", BITS, 0.0)


SQL_BF_B = f"gram_b AS (SELECT DISTINCT unnest({GRAMS}) AS gram FROM rec_b), hm_b AS (SELECT gram, {S.hmac('gram', 'bloomfilter', 'sha1')} AS s, {S.hmac('gram', 'bloomfilter', 'md5')} AS m FROM gram_b), hp_b AS (SELECT gram, {S.big_mod('s', 40, BITS)} AS h1, {S.big_mod('m', 32, BITS)} AS h2 FROM hm_b), bf_b AS (SELECT entity_id, list_sort(list_distinct(flatten(list({_hmac_positions(BF_K)})))) AS bits FROM (SELECT entity_id, unnest(list_distinct({GRAMS})) AS gram FROM rec_b) JOIN hp_b USING (gram) GROUP BY entity_id)"
_BAG = "2.0::DOUBLE * len(list_filter(b.grams, lambda x: list_contains(a.grams, x))) / nullif(len(a.grams) + len(b.grams), 0)"


@query(f"{_LINKED}, {SQL_BF}, {SQL_BF_B} SELECT a.entity_id AS entity_a, b.entity_id AS entity_b, {_BAG} AS sim, {_bit_dice('x.bits', 'y.bits')} AS es_sim FROM ga a JOIN gb b USING (block_key) JOIN bf x ON x.entity_id = a.entity_id JOIN bf_b y ON y.entity_id = b.entity_id")
def link_bf_soundex(spark, d):
    """The similarity of the grams beside that of the keyed filters, for all pairs of a phonetic block."""
    a, b = _bf(spark, d), _grams(_b(spark, d)).withColumn("bits", E.clk(F.col("grams"), BF_K, BITS, "hmac"))
    return L.link_both(a, b, _soundex(a), _soundex(b), "bits", BITS)


_MH = f"WITH {V.SQL_B}, {SQL_CLK}, {SQL_CLK_B}, {_minhash_sql('clk', 'blk_a')}, {_minhash_sql('clk_b', 'blk_b')}, cand AS (SELECT DISTINCT a.entity_id AS entity_a, b.entity_id AS entity_b FROM blk_a a JOIN blk_b b USING (block_key))"


def _minhash_pairs(spark, d, least, base="md5"):
    a, b = _clk(_a(spark, d)), _clk(_b(spark, d))
    return L.link_bits(a, b, _minhash_blocks(_a(spark, d), base), _minhash_blocks(_b(spark, d), base), "bits", BITS, least)


@query(f"{_MH} SELECT * FROM ({_BITPAIRS}) WHERE sim >= 0.5")
def link_bf_minhash(spark, d):
    return _minhash_pairs(spark, d, 0.5)


@query(f"{_MH.replace(_SIG, _SIG_CRC)} SELECT * FROM ({_BITPAIRS}) WHERE sim >= 0.5")
def link_bf_minhash_crc32(spark, d):
    return _minhash_pairs(spark, d, 0.5, "crc32")


@query(f"{_MH} SELECT count(*) AS n_pairs, (SELECT count(*) FROM rec_a) AS n_left, (SELECT count(*) FROM rec_b) AS n_right, round(1.0 - CAST(count(*) AS DOUBLE) / (CAST((SELECT count(*) FROM rec_a) AS DOUBLE) * (SELECT count(*) FROM rec_b)), 6) AS reduction_ratio FROM cand")
def reduction_ratio(spark, d):
    pairs = L.candidates(_minhash_blocks(_a(spark, d), "md5"), _minhash_blocks(_b(spark, d), "md5"))
    return L.reduction_ratio(pairs, _a(spark, d), _b(spark, d))


_STEPS = S.listed(M.THRESHOLDS)
_SWEEP = f"sw AS (SELECT threshold, count(*) FILTER (sim >= threshold AND entity_a = entity_b) AS tp, count(*) FILTER (sim >= threshold AND entity_a <> entity_b) AS fp, (SELECT count(*) FROM rec_a) * (SELECT count(*) FROM rec_b) AS total, count(*) FILTER (sim < threshold AND entity_a = entity_b) AS fn FROM (SELECT * FROM lq WHERE sim >= 0.5), (SELECT CAST(unnest({_STEPS}) AS DOUBLE) AS threshold) GROUP BY threshold)"


def _sweep(spark, d):
    return M.threshold_sweep(_link(spark, d), _a(spark, d), _b(spark, d))


@query(f"{_LINKED}, {_SWEEP} SELECT threshold, tp, fp, total - tp - fp - fn AS tn, fn FROM sw")
def threshold_sweep(spark, d):
    return _sweep(spark, d)


@query(f"{_LINKED}, {_SWEEP} SELECT threshold, round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0.0), 4) AS \"precision\", round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0.0), 4) AS recall FROM sw")
def precision_recall_curve(spark, d):
    return M.precision_recall(_sweep(spark, d))


# ---- experiments by configuration ----------------------------------------------------------------

NAMES = ["attr1", "attr2"]
_HARDENED = {
    "none": "bits",
    "bal": f"list_sort(list_transform(list_concat(bits, list_transform(list_filter(range(0, {BITS}), lambda p: NOT list_contains(bits, p)), lambda p: p + {BITS})), lambda p: {S.listed(_BAL)}[p + 1]))",
    "xor": S.odd(f"list_transform(bits, lambda p: p % {BITS // 2})"),
    "r90": S.odd(f"list_concat(list_transform(bits, lambda p: (p + 1) % {BITS}), list_transform(bits, lambda p: (p + {BITS - 1}) % {BITS}))"),
    "uldp-1": _uldp_sql("bits"),
    "blip-0.1": f"list_filter(range(0, {BITS}), lambda p: {_blip_sql(0.1)})",
}


def _grid_sql(hardenings: list[str], tail: str) -> str:
    """The confusion counts ``sw`` of the filters that the hardenings give, in phonetic blocks."""
    sides = [f"h{k}{s} AS (SELECT entity_id, {_HARDENED[h]} AS bits FROM {t})" for k, h in enumerate(hardenings) for s, t in (("a", "clk"), ("b", "clk_b"))]
    links = [f"SELECT 'clk/dh/{h}/soundex' AS config, entity_a, entity_b, {_bit_dice('x.bits', 'y.bits')} AS sim FROM cand JOIN h{k}a x ON x.entity_id = entity_a JOIN h{k}b y ON y.entity_id = entity_b" for k, h in enumerate(hardenings)]
    counts = f"SELECT config, threshold, count(*) FILTER (sim >= threshold AND entity_a = entity_b) AS tp, count(*) FILTER (sim >= threshold AND entity_a <> entity_b) AS fp, (SELECT count(*) FROM rec_a) * (SELECT count(*) FROM rec_b) AS total, count(*) FILTER (sim < threshold AND entity_a = entity_b) AS fn FROM (SELECT * FROM runs WHERE sim >= 0.5), (SELECT CAST(unnest({_STEPS}) AS DOUBLE) AS threshold) GROUP BY config, threshold"
    return f"{_BOTH_CLK}, {_CANDS}, {', '.join(sides)}, runs AS ({' UNION ALL '.join(links)}), sw AS ({counts}) {tail}"


_PR = "round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0.0), 4) AS \"precision\", round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0.0), 4) AS recall"


@query(_grid_sql(["blip-0.1"], "SELECT threshold, tp, fp, total - tp - fp - fn AS tn, fn FROM sw"))
def private_sweep(spark, d):
    """Confusion counts of hardened filters, encoded, blocked and linked by the names of a configuration."""
    return EX.sweep(_a(spark, d), _b(spark, d), EX.Config.parse("clk/dh/blip-0.1/soundex"), NAMES, "attr2")


GRID = ["none", "xor", "r90", "bal", "uldp-1"]


@query(_grid_sql(GRID, f"SELECT config, threshold, {_PR} FROM sw"))
def private_grid(spark, d):
    """Precision and recall of a grid of configurations."""
    return EX.grid(_a(spark, d), _b(spark, d), EX.configs(["clk"], ["dh"], GRID, ["soundex"]), NAMES, "attr2")


def _keys_sql(keys):
    return f"blk_a AS (SELECT DISTINCT entity_id, unnest({keys}) AS block_key FROM clk), blk_b AS (SELECT DISTINCT entity_id, unnest({keys}) AS block_key FROM clk_b), cand AS (SELECT DISTINCT a.entity_id AS entity_a, b.entity_id AS entity_b FROM blk_a a JOIN blk_b b USING (block_key))"


@query(f"WITH {V.SQL_B}, {SQL_CLK}, {SQL_CLK_B}, {_keys_sql(_RANDOM)} SELECT * FROM ({_BITPAIRS}) WHERE sim >= 0.5")
def link_bf_hlsh(spark, d):
    """Linkage in blocks of sampled bits of the filters."""
    return EX.link(_a(spark, d), _b(spark, d), EX.Config(blocking="hlsh"), NAMES, "attr2")


@query(f"WITH {V.SQL_B}, {SQL_CLK}, {SQL_CLK_B}, {_keys_sql(_SEGMENT)} SELECT * FROM ({_BITPAIRS}) WHERE sim >= 0.5")
def link_bf_hlsh_segment(spark, d):
    return EX.link(_a(spark, d), _b(spark, d), EX.Config(blocking="hlsh-segment"), NAMES, "attr2")


@query(_sql_shown(S.odd(f"list_transform(bits, lambda p: p % {BITS // 2})"), "rbf", f"{V.SQL_A}, rbf AS (SELECT entity_id, {_rbf_bits('')} AS bits FROM rec_a)"))
def rbf_hardened(spark, d):
    df, _ = EX.encode(_a(spark, d), EX.Config(encoder="rbf", hardening="xor"), NAMES)
    return _shown(df)


@query(_sql_shown("bits", "clk", f"{V.SQL_A}, {SQL_CLK.replace(f'{GRAMS} AS grams', f'list_transform({GRAMS}, lambda s: s || salt) AS grams')}"))
def clk_salt_hardened(spark, d):
    """The configuration that salts the grams and leaves the filter as it is."""
    df, _ = EX.encode(_a(spark, d), EX.Config(encoder="clk-salt", hardening="salt"), NAMES)
    return _shown(df)


TS = [3.0, 5.0, 7.0, 9.0]
_DOMAINS = {"ages": (V.SQL_N, V.LOW, V.HIGH), "heights": (f"num AS (SELECT id, CASE WHEN v < 140.0 THEN CAST(140.0 AS DOUBLE) ELSE floor(least(v, CAST(200.0 AS DOUBLE))) END AS value FROM (SELECT c_custkey AS id, CAST({_HEIGHT} AS DOUBLE) AS v FROM customer))", 140.0, 200.0)}


def _domain_sql(name):
    num, low, high = _DOMAINS[name]
    shared = N.thresholds(M_BITS, low, high)
    enc = f"enc AS (SELECT id, value, list_filter(range(0, {M_BITS}), lambda i: value >= {S.listed(shared)}[i + 1]) AS bits FROM num)"
    return f"""SELECT '{name}' AS domain, t AS threshold, round(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 9) AS "precision", round(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 9) AS recall, round(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 9) AS f1
FROM (WITH {num}, {enc}, noisy AS (SELECT id, value, {_DPRL} AS bits FROM enc), packed AS (SELECT id, value, {S.bit_string('bits', M_BITS)} AS v FROM noisy),
  met AS (SELECT abs(a.value - b.value) AS true_dis, bit_count(xor(a.v, b.v)) AS hd, count(*) AS n FROM packed a JOIN packed b ON a.id < b.id GROUP BY 1, 2),
  est AS (SELECT true_dis, n, (CAST(hd AS DOUBLE) / 1.1 / {M_BITS} - {(1 - 0.8 * 0.8) / 2!r}) * {high - low} / {0.8 * 0.8!r} AS est FROM met)
  SELECT t, sum(n) FILTER (est <= t AND true_dis <= t) AS tp, coalesce(sum(n) FILTER (est <= t AND true_dis > t), 0) AS fp, coalesce(sum(n) FILTER (est > t AND true_dis <= t), 0) AS fn FROM est, (SELECT CAST(unnest({TS}) AS DOUBLE) AS t) GROUP BY t)"""


@query(" UNION ALL ".join(_domain_sql(d) for d in _DOMAINS))
def distance_grid(spark, d):
    """Precision, recall and F1 of "distance <= T" on noisy vectors of ages and heights, for four T."""
    out = None
    for name, (_, low, high) in _DOMAINS.items():
        rows = V.numbers(spark, d) if name == "ages" else gen_heights(spark, d)
        noisy = rows.withColumn("bits", N.noise_dprl(N.threshold_bits(F.col("value"), N.thresholds(M_BITS, low, high)), M_BITS, F.col("id")))
        pairs = N.decided(_summary(noisy, _dprl_estimate(high - low), TS), TS)
        p = EX.distance_grid(pairs, F.col("est_dis"), TS).select(F.lit(name).alias("domain"), "*")
        out = p if out is None else out.unionByName(p)
    return out


_LINE = " || ' ' || ".join(f"printf('%.6f', {c})" for c in ('"precision"', "recall", "f1"))


@query(f"SELECT domain, threshold, {_LINE} AS line FROM ({' UNION ALL '.join(_domain_sql(d) for d in _DOMAINS)})")
def store_prf(spark, d):
    """The lines of the result files: precision, recall and F1, with spaces between."""
    return distance_grid(spark, d).select("domain", "threshold", files.score_line(["precision", "recall", "f1"]).alias("line"))


@query(f"{_LINKED}, {SQL_BF}, {SQL_BF_B} SELECT CAST('0x' || substr(md5(entity_a || ' ' || entity_b), 1, 8) AS BIGINT) % 8 AS shard, printf('%.6f', sim) || ' ' || printf('%.6f', es_sim) AS line FROM (SELECT a.entity_id AS entity_a, b.entity_id AS entity_b, {_BAG} AS sim, {_bit_dice('x.bits', 'y.bits')} AS es_sim FROM ga a JOIN gb b USING (block_key) JOIN bf x ON x.entity_id = a.entity_id JOIN bf_b y ON y.entity_id = b.entity_id)")
def store_similarities(spark, d):
    """The lines of the similarity files, true and estimated, dealt into eight shards."""
    shard = F.conv(F.substring(F.md5(F.concat_ws(" ", "entity_a", "entity_b")), 1, 8), 16, 10).cast("long") % 8
    return link_bf_soundex(spark, d).select(shard.alias("shard"), files.score_line(["sim", "es_sim"]).alias("line"))


# ---- statistics and stores -----------------------------------------------------------------------


@query(f"WITH {WITH_CLK} SELECT entity_id, CAST(len(grams) AS INTEGER) AS n_grams, CAST(len(grams) - len(list_distinct(grams)) AS INTEGER) AS n_dup FROM clk")
def stat_dup_qgram(spark, d):
    n, dup = M.duplicate_grams(F.col("grams"))
    return _grams(_a(spark, d)).select("entity_id", n.alias("n_grams"), dup.alias("n_dup"))


@query(f"WITH {WITH_CLK} SELECT entity_id, CAST(len(bits) AS INTEGER) AS ones, CAST(len(grams) AS INTEGER) AS n_grams, round(CAST(len(bits) AS DOUBLE) / nullif(len(grams), 0), 6) AS ratio FROM clk")
def stat_bits_per_qgram(spark, d):
    return _clk(_a(spark, d)).select("entity_id", F.size("bits").alias("ones"), F.size("grams").alias("n_grams"), F.round(M.bits_per_gram(F.col("bits"), F.col("grams")), 6).alias("ratio"))


@query(f"WITH {WITH_CLK} SELECT entity_id AS \"ID\", array_to_string(grams, ' ') AS \"QGram\" FROM clk")
def store_qgrams(spark, d):
    return files.gram_lines(_grams(_a(spark, d)))


@query(f"WITH {WITH_CLK} SELECT entity_id AS \"ID\", '{{' || array_to_string(bits, '  ') || '}}' AS \"BF\" FROM clk")
def store_filters(spark, d):
    return files.filter_lines(_clk(_a(spark, d)))


@query(f"{_LINKED} SELECT greatest(entity_a, entity_b) || ' ' || least(entity_a, entity_b) || ' ' AS \"IDPair\", printf('%.4f', round(sim, 4)) AS \"Sim\" FROM lq WHERE sim >= 0.5")
def store_pairs(spark, d):
    return files.pair_lines(_link(spark, d))
