"""URL rules and block lists by a cascade of Bloom filters (operator 12).

A url's keys are the suffixes of its host, each with the beginnings of its path that rules can name. The distinct keys of all
urls are the corpus's key universe. A cascade encodes a list of keys over that universe: its first filter holds the listed
keys, the next one the unlisted keys that the first takes for listed, the next one the listed keys that this one takes for
unlisted, and so on until no key is taken wrongly. So membership is exact for each key of the corpus, with a few bits a listed
key, and urls need no join with the lists.

Keys are dealt to shards of about KEYS_A_SHARD by hash; a task builds the cascades of a shard. Filters reach the urls by
broadcast, in groups of shards of at most MOST_BYTES, one pass over the urls a group; between passes the urls are written.

Rules (host, path, verdict) fit their host and its subdomains where the path begins with the rule's. The longest fitting rule
wins, counting host and path, and of these the one with the longest host. Where none fits, urls are blocked whose host, or a
domain above it, is on the block list.

Defined results: a null url, and one without ``://``, has an empty host and path, no rule, and is allowed. Hosts are compared
in lower case (A-Z), paths as they are; ports and users are part of the host. A rule repeated with another verdict blocks. Rules
and listed hosts that are null or empty are dropped. Rows that repeat a page_id or a whole row are judged each; an empty table
gives no rows, and empty lists allow all. Very long urls have as many keys as others: as the longest rule has labels.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.shared import dropped, written
from paperloom.llm.words import U, mix

KEYS_A_SHARD = 200_000
MOST_BYTES = 1 << 25  # of filters broadcast at once
MOST_LEVELS = 300  # reached only if a listed and an unlisted key share all 128 bits
BLOCK, ALLOW, LISTED = "block", "allow", "listed"
CLASSES = (BLOCK, ALLOW, LISTED)
FILTERS = "shard long, class int, level int, hashes int, n_bits long, bits binary"


class Filter:
    """One Bloom filter; each level places keys by hashes of its own."""

    def __init__(self, level: int, hashes: int, n_bits: int, bits: np.ndarray):
        self.level, self.hashes, self.n_bits, self.bits = level, hashes, n_bits, bits

    @staticmethod
    def of(keys: np.ndarray, level: int, share: float) -> "Filter":
        """keys: two 64-bit hashes a row; share: of other keys taken for these."""
        hashes = max(1, round(-np.log2(share)))
        n_bits = int(np.ceil(len(keys) * hashes / np.log(2) / 8)) * 8 + 8
        out = Filter(level, hashes, n_bits, np.zeros(n_bits // 8, np.uint8))
        for at in out._places(keys):
            np.bitwise_or.at(out.bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        return out

    def _places(self, keys: np.ndarray):
        salt = U((self.level + 1) * 0xD6E8FEB86659FD93 % 2**64)
        first, step = mix(keys[:, 0] + salt), mix(keys[:, 1] ^ salt) | U(1)
        for i in range(self.hashes):
            yield ((first + U(i) * step) % U(self.n_bits)).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        left = np.arange(len(keys))
        for at in self._places(keys):
            bit = at[left]
            left = left[(self.bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1]
        out = np.zeros(len(keys), bool)
        out[left] = True
        return out


def cascade(listed: np.ndarray, others: np.ndarray) -> list[Filter]:
    """Filters that tell the listed keys from the others exactly; rows of two 64-bit hashes."""
    levels: list[Filter] = []
    inside, outside = listed, others
    while len(inside):
        if len(levels) == MOST_LEVELS:
            raise ValueError("a listed and an unlisted key have the same hashes")
        # The first filter lets about as many pass as are listed, the others half.
        share = min(0.5, max(1e-9, len(listed) / (1.414 * max(1, len(others))))) if not levels else 0.5
        levels.append(Filter.of(inside, len(levels), share))
        inside, outside = outside[levels[-1].has(outside)], inside
    return levels


def members(levels: list[Filter], keys: np.ndarray) -> np.ndarray:
    """Which keys of the universe are listed: the number of filters that hold a key, in turn, is odd."""
    out, left = np.zeros(len(keys), bool), np.arange(len(keys))
    for f in levels:
        left = left[f.has(keys[left])]
        out[left] = f.level % 2 == 0
    return out


def hashed(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit(0x51ED), key)


def _builder(frames):
    for frame in _shards(frames):
        keys = frame[["h1", "h2"]].to_numpy(np.int64).view(np.uint64)
        found = []
        for number in range(len(CLASSES)):
            listed = (frame["classes"].to_numpy(np.int64) >> number & 1) == 1
            found += [(int(frame["shard"].iloc[0]), number, f.level, f.hashes, f.n_bits, f.bits.tobytes()) for f in cascade(keys[listed], keys[~listed])]
        yield pd.DataFrame(found, columns=["shard", "class", "level", "hashes", "n_bits", "bits"])


def _shards(frames):
    """The rows of each shard, of frames sorted by it."""
    held: list = []
    for frame in frames:
        for shard, part in frame.groupby("shard", sort=False):
            if held and held[0]["shard"].iloc[0] != shard:
                yield pd.concat(held)
                held = []
            held.append(part)
    if held:
        yield pd.concat(held)


class Cascades:
    """The filters of all shards, as a written table, with the number of shards."""

    def __init__(self, filters: DataFrame, n_shards: int):
        self.filters, self.n_shards = filters, n_shards


def build(universe: DataFrame, lists: DataFrame, keys_a_shard: int = KEYS_A_SHARD) -> Cascades:
    """Cascades over the keys of universe (key) that tell which are in lists (key, class number)."""
    one, two = hashed(F.col("key"))
    named = lists.select(one.alias("h1"), two.alias("h2"), F.expr("shiftleft(1, class)").alias("classes"))
    every = universe.select(one.alias("h1"), two.alias("h2"), F.lit(0).alias("classes"))
    # Keys meet their list entries in one aggregation; entries that no url has only widen the universe.
    keys = written(every.unionByName(named).groupBy("h1", "h2").agg(F.bit_or("classes").alias("classes")), "url-keys")
    n_shards = max(1, -(-keys.count() // keys_a_shard))
    keys_of = keys.withColumn("shard", F.pmod(F.col("h1"), F.lit(n_shards)))
    dealt = keys_of.repartition(n_shards, "shard").sortWithinPartitions("shard")
    filters = written(dealt.mapInPandas(_builder, FILTERS), "url-filters")
    dropped(keys)
    return Cascades(filters, n_shards)


def groups(cascades: Cascades, most_bytes: int) -> list[tuple[int, int]]:
    """Ranges of shards whose filters take most_bytes at most (or a single shard)."""
    width = cascades.filters.groupBy("shard").agg(F.sum(F.length("bits")).alias("n"))
    step = max(1, int(most_bytes // (width.agg(F.max("n")).first()[0] or 1)))
    return [(a, min(a + step, cascades.n_shards)) for a in range(0, cascades.n_shards, step)]


def _prober(filters, n_shards: int, low: int, high: int):
    """Adds to each row the best place, in its list of keys, of each class; -1: none. The lists are equally long."""

    def probe(batches):
        levels: dict[tuple[int, int], list[Filter]] = {}
        for shard, number, level, hashes, n_bits, bits in sorted(filters.value):
            levels.setdefault((shard, number), []).append(Filter(level, hashes, n_bits, np.frombuffer(bits, np.uint8)))
        for batch in batches:
            n = batch.num_rows
            keys = np.stack([batch.column(c).flatten().to_numpy().view(np.uint64) for c in ("h1", "h2")], 1)
            size = batch.column("size").flatten().to_numpy().reshape(n, -1)
            shard = keys[:, 0].view(np.int64) % n_shards
            best = np.stack([batch.column(c).to_numpy() for c in CLASSES], 1)
            for number in range(len(CLASSES)):
                hit = np.zeros(len(keys), bool)
                for s in np.unique(shard[(shard >= low) & (shard < high)]):
                    mine = np.flatnonzero(shard == s)
                    hit[mine] = members(levels.get((int(s), number), []), keys[mine])
                reach = np.where(hit.reshape(size.shape) & (size >= 0), size, -1)
                best[:, number] = np.maximum(best[:, number], reach.max(1))
            kept = [c for c in batch.schema.names if c not in CLASSES]
            arrays = [batch.column(c) for c in kept] + [pa.array(best[:, i]) for i in range(len(CLASSES))]
            yield pa.RecordBatch.from_arrays(arrays, [*kept, *CLASSES])

    return probe


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url)))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), upper, lower)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _places(n_labels: int, lengths: list[int]) -> list[tuple[int, int]]:
    """A url's keys as (labels of its host from the end, characters of its path)."""
    return [(k, n) for k in range(1, n_labels + 1) for n in lengths]


def _keys(places: list[tuple[int, int]]) -> Column:
    """The key strings at the places; null where the url has fewer labels or a shorter path."""
    there = lambda k, n: (F.col("labels") >= k) & (F.length("path") >= n)
    return F.array(*(F.when(there(k, n), F.concat(F.substring_index("host", ".", -k), F.substring("path", 1, n))) for k, n in places))


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, keys_a_shard: int = KEYS_A_SHARD, most_bytes: int = MOST_BYTES) -> DataFrame:
    """page_id, host, path, rule and verdict of each row of pages (page_id, url), by rules (host, path, verdict) and
    blocked hosts (host)."""
    host, path = host_and_path(F.col("url").cast("string"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("labels", _labels(F.col("host")))
    number = F.when(F.col("verdict") == BLOCK, 0).otherwise(1)
    whole = rules.select("host", F.coalesce("path", F.lit("")).alias("path"), number.alias("class"))
    whole = whole.unionByName(listed.select("host", F.lit("").alias("path"), F.lit(2).alias("class"))).where("host <> ''")
    whole = whole.withColumn("labels", _labels(F.col("host")))
    shape = whole.agg(F.max("labels"), F.collect_set(F.length("path"))).first()  # lengths: fewer than the longest path has characters
    places = _places(shape[0] or 1, sorted(shape[1]) or [0])
    keys = urls.select("host", F.substring("path", 1, max(n for _, n in places)).alias("path"), "labels").distinct()
    universe = keys.select(F.explode(_keys(places)).alias("key")).where(F.col("key").isNotNull()).distinct()
    cascades = build(universe, whole.select(F.concat("host", "path").alias("key"), "class").distinct(), keys_a_shard)
    # Whole length first, then the longer host; the place comes back from the remainder.
    n = len(places)
    sizes = F.transform("keys", lambda key, i: F.when(key.isNotNull(), F.length(key).cast("long") * n + i.cast("long")).otherwise(F.lit(-1).cast("long")))
    rows = urls.withColumn("keys", _keys(places)).withColumn("size", sizes)
    one = F.transform("keys", lambda key: F.coalesce(hashed(key)[0], F.lit(0).cast("long")))
    two = F.transform("keys", lambda key: F.coalesce(hashed(key)[1], F.lit(0).cast("long")))
    rows = rows.select("page_id", "host", "path", "size", one.alias("h1"), two.alias("h2"), *(F.lit(-1).cast("long").alias(c) for c in CLASSES))
    passes = groups(cascades, most_bytes)
    for low, high in passes:
        found = cascades.filters.where(F.col("shard").between(low, high - 1)).collect()  # most_bytes at most
        filters = pages.sparkSession.sparkContext.broadcast([tuple(r) for r in found])
        rows = rows.mapInArrow(_prober(filters, cascades.n_shards, low, high), rows.schema)
        if high < passes[-1][1]:
            rows = written(rows, "url-pass")
    place = F.greatest(BLOCK, ALLOW)
    k, length = (F.element_at(F.array(*(F.lit(p[i]) for p in places)), (place % n + 1).cast("int")) for i in (0, 1))
    suffix = F.element_at(F.array(*(F.substring_index("host", ".", -i) for i in range(1, max(k for k, _ in places) + 1))), k)
    rule = F.when(place >= 0, F.concat(suffix, F.substr("path", F.lit(1), length)))
    blocked = F.when(place >= 0, F.col(BLOCK) == place).otherwise(F.col(LISTED) >= 0)
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.when(blocked, BLOCK).otherwise(ALLOW).alias("verdict"))


# Fixed values of the query: its rules, and words of a host's labels for which the host goes on the block list.
RULES = [("net", "/", BLOCK), ("example.net", "/en/", ALLOW), ("example.com", "/de/", BLOCK), ("org", "/fr/", ALLOW)]
WORDS = ["adult", "ads", "bets", "casino", "pills", "spam"]
WORD = f"(^|[.-])({'|'.join(WORDS)})([.-]|$)"


def hosts_with(pages: DataFrame, pattern: str) -> DataFrame:
    """A block list: the corpus's hosts that match."""
    host, _ = host_and_path(F.col("url").cast("string"))
    return pages.select(host.alias("host")).distinct().where(F.col("host").rlike(pattern))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: the verdict on every page's url."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(pages, rules, written(hosts_with(pages, WORD), "block-list"))


SQL = f"""with urls as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end rest from pages),
parts as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from urls),
ruled as (select *, case
  when concat('.', host) like '%.example.net' and starts_with(path, '/en/') then 'example.net/en/'
  when concat('.', host) like '%.example.com' and starts_with(path, '/de/') then 'example.com/de/'
  when concat('.', host) like '%.org' and starts_with(path, '/fr/') then 'org/fr/'
  when concat('.', host) like '%.net' and starts_with(path, '/') then 'net/' end "rule" from parts)
select page_id, host, path, "rule", case when "rule" in ('net/', 'example.com/de/') then 'block' when "rule" is not null then 'allow'
  when regexp_matches(host, '{WORD}') then 'block' else 'allow' end verdict from ruled"""
