"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each read as a word of the perfect (23, 12)
Golay code. Every word decodes to one codeword at distance 3 or less; the codewords at distance 4 or less are its
nearby codewords (one of them, or six). Two words that differ in at most two bits always have a nearby codeword in
common, and the decoded codeword of one of two words that differ in at most one bit is always near the other.

Of at most four differing bits, the three segments can get, largest first,
  * none in one segment, and two at most in one of the others: exact bits of the first, nearby index of the second;
  * two, one and one: decoded index of the two segments with one error on one side, nearby indices on the other.
Fingerprints that meet in a key are compared bit by bit, so the keys only have to miss nothing.

Defined results: a null or blank text has fingerprint zero and is linked like any other; fewer words than a
shingle make one shingle of the whole sequence; repeated rows and rows with a null id each stay a row (a null id is
never the smallest of its group unless all are null); rows with one id and different texts are grouped by their texts;
an empty table gives an empty result.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import land, ship_package
from .components import connected_components

SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, number of bits
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, the Golay code's generator polynomial


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a text, ASCII letters in lower case."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[shingle - 1:].tolist())]
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # a very long text is counted in slices
        part = np.array(hashes[at:at + (1 << 16)], dtype="<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = 4, out: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of ``text_col`` as a signed 64-bit column ``out``."""
    ship_package(docs.sparkSession)

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        values = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64)
        return pd.Series(values.view(np.int64))

    return docs.withColumn(out, prints(F.col(text_col)))


@cache
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of the 2,048 remainders by the generator: the nearest codeword's error pattern, all (one or six)
    error patterns of weight 4 or less, and how many they are."""
    def remainder(x: int) -> int:
        for bit in range(22, 10, -1):
            if x >> bit & 1:
                x ^= GENERATOR << (bit - 11)
        return x

    unit = [remainder(1 << i) for i in range(23)]
    found: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            s = 0
            for b in bits:
                s ^= unit[b]
            found[s].append(sum(1 << b for b in bits))
    count = np.array([len(f) for f in found])
    near = np.zeros((2048, int(count.max())), np.int64)
    for s, f in enumerate(found):
        near[s, :len(f)] = f
    return near[:, 0].copy(), near, count


def _remainders(x: np.ndarray) -> np.ndarray:
    r = x.copy()
    for bit in range(22, 10, -1):
        r ^= np.where(r >> bit & 1, GENERATOR << (bit - 11), 0)
    return r


def decoded(x: np.ndarray) -> np.ndarray:
    """12-bit index of the codeword nearest to each 23-bit word."""
    return (x ^ golay_tables()[0][_remainders(x)]) >> 11


def nearby(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all codewords at distance 4 or less, one row a word, and how many of each row count."""
    _, near, count = golay_tables()
    r = _remainders(x)
    return (x[:, None] ^ near[r]) >> 11, count[r]


def golay_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, role, key) of all keys of signed 64-bit fingerprints. Role 0 meets role 0; role 1 (decoded) meets
    role 2 (nearby). The family of a key is in its low bits."""
    u = prints.view(np.uint64)
    seg = [((u >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    near = [nearby(s) for s in seg]
    nearest = [decoded(s) for s in seg]
    width = near[0][0].shape[1]
    slot = np.arange(width)
    rows, roles, keys = [], [], []

    def put(row, role, key):
        rows.append(row)
        roles.append(np.full(len(row), role, np.int8))
        keys.append(key)

    every = np.arange(len(u))
    family = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                index, count = near[j]
                r, c = np.nonzero(slot[None, :] < count[:, None])
                put(r, 0, ((seg[i][r] << 12 | index[r, c]) << 4) | family)
                family += 1
    for i, j in combinations(range(3), 2):
        put(every, 1, ((nearest[i] << 12 | nearest[j]) << 4) | family)
        (a, na), (b, nb) = near[i], near[j]
        r, c, d = np.nonzero((slot[None, :, None] < na[:, None, None]) & (slot[None, None, :] < nb[:, None, None]))
        put(r, 2, ((a[r, c] << 12 | b[r, d]) << 4) | family)
        family += 1
    return np.concatenate(rows), np.concatenate(roles), np.concatenate(keys)


def _differing(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def hub_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of nine narrow keys a fingerprint: the bits of two segments, or the bits of one and the decoded index
    of another."""
    u = prints.view(np.uint64)
    seg = [((u >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    nearest = [decoded(s) for s in seg]
    keys = [seg[i] << 22 | seg[j] for i, j in combinations(range(3), 2)]
    keys += [seg[i] << 22 | nearest[j] for i in range(3) for j in range(3) if i != j]
    return (np.tile(np.arange(len(u)), len(keys)),
            np.concatenate([k << 4 | family for family, k in enumerate(keys)]))


def _hub_links(prints: DataFrame, max_bits: int) -> DataFrame:
    """Links of each fingerprint with the smallest one that has a narrow key in common. This only joins nearly all of a
    dense group beforehand; the Golay keys find every other link."""
    def keys(batches):
        for pdf in batches:
            p = pdf["p"].to_numpy(np.int64)
            row, key = hub_keys(p)
            yield pd.DataFrame({"key": key, "p": p[row]})

    keyed = prints.mapInPandas(keys, "key long, p long")
    hubs = keyed.groupBy("key").agg(F.min("p").alias("hub"))
    return (keyed.join(hubs, "key").where((F.col("p") != F.col("hub")) & (_differing("p", "hub") <= max_bits))
            .select(F.col("hub").alias("a"), F.col("p").alias("b")).distinct())


def fingerprint_links(prints: DataFrame, max_bits: int = 4) -> DataFrame:
    """(a, b) links that join exactly the fingerprints ``prints(p)`` (distinct) that a chain of pairs with at most
    ``max_bits`` differing bits joins.

    Links inside a group that hubs have joined already are left out, so a dense group does not emit all its pairs.
    """
    if not 0 <= max_bits <= 4:
        raise ValueError("the keys cover at most four differing bits")
    ship_package(prints.sparkSession)
    first = land(_hub_links(prints, max_bits), "hub-links")
    joined = connected_components(first).withColumnRenamed("node", "p")
    labelled = prints.join(joined, "p", "left").select("p", F.coalesce("component", "p").alias("label"))

    def keys(batches):
        for pdf in batches:
            p, label = pdf["p"].to_numpy(np.int64), pdf["label"].to_numpy(np.int64)
            for at in range(0, len(p), 1000):
                row, role, key = golay_keys(p[at:at + 1000])
                yield pd.DataFrame({"key": key, "role": role, "p": p[at:at + 1000][row],
                                    "label": label[at:at + 1000][row]})

    keyed = labelled.mapInPandas(keys, "key long, role byte, p long, label long")

    def side(role, name):
        return keyed.where(F.col("role") == role).select(
            "key", F.col("p").alias(name), F.col("label").alias(f"label_{name}"))

    def met(left, right):
        return left.join(right, "key").where((F.col("label_a") != F.col("label_b"))
                                             & (_differing("a", "b") <= max_bits)).select("a", "b")

    same = met(side(0, "a"), side(0, "b")).where("a < b")
    return first.unionByName(same).unionByName(met(side(1, "a"), side(2, "b"))).distinct()


def _mark(text: Column) -> Column:
    """96 bits that tell the texts of one id apart."""
    return F.struct(F.xxhash64(text).alias("x"), F.hash(text).alias("m"))


def _groups(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int, mark: bool = False) -> DataFrame:
    """(id, fingerprint, component_id, linked) for every row: the smallest id that a chain of links reaches, and the
    smallest fingerprint, which names the component also where ids are null or name several texts. ``mark`` adds a
    column of that name, by which the rows' texts are found again without another fingerprint."""
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marks = ["mark"] if mark else []
    if mark:
        text = text.withColumn("mark", _mark(F.col("text")))
    rows = land(with_fingerprints(text, "text", shingle).select("id", "fingerprint", *marks), "fingerprints")
    classes = land(rows.groupBy(F.col("fingerprint").alias("p")).agg(F.min("id").alias("first")), "classes")
    joined = connected_components(fingerprint_links(classes.select("p"), max_bits)).withColumnRenamed("node", "p")
    labelled = classes.join(joined, "p", "left")
    smallest = (labelled.where("component is not null").groupBy("component").agg(F.min("first").alias("least")))
    named = land(labelled.join(smallest, "component", "left")
                 .select(F.col("p").alias("fingerprint"), F.coalesce("least", "first").alias("component_id"),
                         F.coalesce("component", "p").alias("linked")), "named")
    return rows.join(named, "fingerprint").select("id", "fingerprint", "component_id", "linked", *marks)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                       max_bits: int = 4) -> DataFrame:
    """(id, fingerprint, component_id) for every row of ``docs``: the smallest id that a chain of links reaches (null
    if no row of the chain has an id; the id of several texts can name several chains)."""
    return _groups(docs, id_col, text_col, shingle, max_bits).drop("linked")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                      max_bits: int = 4) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that with the smallest id (a null id only if all are
    null; of rows of that id the smallest fingerprint; of repeated rows, one). Groups are told apart by their fingerprints,
    not by ids; fingerprints are computed once, and the rows that stay are found again by id and a hash of the text."""
    found = land(_groups(docs, id_col, text_col, shingle, max_bits, mark=True), "components")
    keep = (found.groupBy("linked").agg(F.min(F.struct(F.col("id").isNull(), "id", "fingerprint", "mark")).alias("k"))
            .select(F.col("k.id").alias("__keep_id"), F.col("k.mark").alias("__keep_mark")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"),
                       F.col(id_col).alias("__id"), _mark(F.col(text_col)).alias("__mark"))
    kept = rows.join(keep, (F.col("__id").eqNullSafe(F.col("__keep_id"))) & (F.col("__mark") == F.col("__keep_mark")))
    return kept.dropDuplicates(["__keep_id", "__keep_mark"]).select("__row.*")
