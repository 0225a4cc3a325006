"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint is the bit majority of the XXH64 values of a text's word shingles. Two
fingerprints that differ in 3 bits or fewer meet at a variant in the middle:

* at distance 0, 1 or 2 both flip one bit or none ("near" variants, 65 each);
* at distance 3 their bit parities differ, and two of the three differing bits lie in
  the same 32-bit half. The odd one flips these two ("far" variants, 992), the even one
  flips the third. So only odd fingerprints emit far variants, and only pairs of one half.

Variants are shuffled in packs. Far variants of one half leave the other half alone, so a pack is
keyed by the variant without ``FREE`` bits of the flipped half, and stands for all variants that
differ in these bits only; each half has its own family of packs. A fingerprint sends 82 packs if
even and 138 if odd, instead of 65 and 1,057 variants, with 8 + 8 bytes each. Packs of one
fingerprint alone end there; those of up to ``SPLIT`` members are spread out into their variants in the
task that receives them. The members of a larger pack (2 ** FREE at most) are dealt over tasks before they are
spread out, and their variants shuffled one by one, so no task holds more than a variant's members
of such a pack at once.

Whatever the near members of a variant came from lies within 1 bit of it, and a far one
within 2, so a near member is within 3 bits of every other member: a link to the smallest
near member verifies by construction, and is checked by distance all the same. A variant
has at most 65 + 992 different members, whatever the number of documents, and gives
one link per member instead of all pairs. Two far members alone are no link; if they are
close they meet elsewhere. Fingerprints are distinct before they are sent, so copies of a
text cost one row.

Links are closed over components (``graph``); every table between the steps is written
below the shared folder.

Defined results: null, empty and blank texts have fingerprint 0 and are linked like any
other; a text with fewer words than a shingle is one shingle; a null id takes part and
never becomes a component's id unless all ids there are null; rows with equal ids or
texts are all kept; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let_go, materialise, tmp_names
from .graph import connected_components

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Bits of a half that a pack's key leaves out.
FREE = 24
#: Members of a pack that are spread out in one task.
SPLIT = 4096
#: Shingles whose bits are counted at once.
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint of one text, as a signed integer.

    A-Z are lower-cased, words split at ASCII white space; bytes.lower and bytes.split do
    exactly that. A bit is 1 if it is set in over half of the shingles' hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) < shingle:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    ones, n = np.zeros(64, np.int64), len(starts)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _CHUNK):
        h = [digest(line[s:e], seed) for s, e in zip(starts[at : at + _CHUNK].tolist(), ends[at : at + _CHUNK].tolist())]
        ones += np.unpackbits(np.array(h, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).astype(np.uint8)).view(">i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` without its text, with the signed fingerprint ``name``."""
    keep = [c for c in docs.columns if c != text]
    schema = docs.select(*keep).withColumn(name, F.lit(0).cast("long")).schema

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            seen: dict = {}
            fps = []
            for t in batch.column(batch.num_columns - 1):
                t = t.as_py()
                if t not in seen:
                    seen[t] = fingerprint(t, shingle)
                fps.append(seen[t])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps, pa.int64())], names=[*keep, name])

    return docs.select(*keep, text).mapInArrow(compute, schema)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _masks(near: Sequence[int], far: Sequence[int] = ()) -> Column:
    """A literal array of masks with what they make: near variants or far ones."""
    both = [(m, True) for m in near] + [(m, False) for m in far]
    return F.array(*[F.struct(F.lit(_signed(m)).cast("long").alias("mask"), F.lit(n).alias("near")) for m, n in both])


class Family:
    """The packs of one half: its ``FREE`` lower bits are left out of the key."""

    def __init__(self, half: int):
        low = 32 * half
        bits = [1 << b for b in range(low, low + 32)]
        self.free, self.top = bits[:FREE], bits[FREE:]
        self.other = [1 << b for b in range(32 - low, 64 - low)]
        self.number, self.key_mask, self.top_mask = half, (1 << 64) - 1 - sum(self.free), sum(self.top)

    def packs(self, nodes: DataFrame) -> DataFrame:
        """(family, pack, fp): flips of key bits, none, one or (odd fingerprints) two of the half."""
        near = [0, *self.top, *self.other]
        odd = F.bit_count("fp") % 2 == 1
        masks = [F.array(*[F.lit(_signed(m)).cast("long") for m in x]) for x in (near, [*near, *map(sum, combinations(self.top, 2))])]
        sent = nodes.select("fp", F.explode(F.when(odd, masks[1]).otherwise(masks[0])).alias("mask"))
        key = F.col("fp").bitwiseXOR(F.col("mask")).bitwiseAND(F.lit(_signed(self.key_mask)))
        return sent.select(F.lit(self.number).alias("family"), key.alias("pack"), "fp")

    def spread(self) -> Column:
        """The masks of the left-out bits that a pack's member takes."""
        flipped = F.col("fp").bitwiseXOR(F.col("pack")).bitwiseAND(F.lit(_signed(self.key_mask)))
        n, odd, in_half = F.bit_count(flipped), F.bit_count("fp") % 2 == 1, flipped.bitwiseAND(F.lit(_signed(self.top_mask))) != 0
        pairs = list(map(sum, combinations(self.free, 2)))
        return (F.when((n == 0) & odd, _masks([0, *self.free], pairs)).when(n == 0, _masks([0, *self.free]))
                .when(n == 2, _masks([], [0])).when(odd & in_half, _masks([0], self.free)).otherwise(_masks([0])))


def links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) whose closure connects all ``fp`` of ``nodes`` that differ in 3 bits or fewer."""
    upper, lower = Family(1), Family(0)
    sent = upper.packs(nodes).unionByName(lower.packs(nodes))
    members = F.count(F.lit(1)).over(Window.partitionBy("family", "pack"))
    met = materialise(sent.withColumn("members", members).filter("members > 1"), "simhash-packs")
    spread = F.explode(F.when(F.col("family") == 1, upper.spread()).otherwise(lower.spread()))
    # the variant within its pack: the left-out bits of the flipped fingerprint
    rest = F.when(F.col("family") == 1, F.lit(_signed((1 << 64) - 1 - upper.key_mask))).otherwise(F.lit(_signed((1 << 64) - 1 - lower.key_mask)))

    def variants(packs: DataFrame) -> DataFrame:
        flipped = packs.select("family", "pack", "fp", spread.alias("s"))
        return flipped.select("family", "pack", "fp", "s.near", F.col("fp").bitwiseXOR(F.col("s.mask")).bitwiseAND(rest).alias("rest"))

    def rooted(made: DataFrame) -> DataFrame:
        root = F.min(F.when(F.col("near"), F.col("fp"))).over(Window.partitionBy("family", "pack", "rest"))
        return made.select("fp", root.alias("root")).filter("root is not null and root != fp")

    small = rooted(variants(met.filter(F.col("members") <= SPLIT).repartition("family", "pack")))
    large = rooted(variants(met.filter(F.col("members") > SPLIT).repartition("family", "pack", "fp")).repartition("family", "pack", "rest"))
    found = small.unionByName(large).distinct()
    return found.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("root"))) <= RADIUS).select(F.col("fp").alias("a"), F.col("root").alias("b"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(key, fingerprint long, component_id): the smallest id reachable over links, for every row."""
    fps = materialise(fingerprints(docs.select(F.col(key).alias("id"), F.col(text).alias("t")), "t", "fp", shingle), "simhash-fps")
    nodes = materialise(fps.groupBy("fp").agg(F.min("id").alias("least")), "simhash-nodes")
    stars = connected_components(links(nodes.select("fp")))
    rooted = nodes.join(stars.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left")
    rooted = materialise(rooted.select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select(F.col("id").alias(key), F.col("fp").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row of each near-duplicate group: the one with the smallest id.

    A row is its id and text: rows with equal ids and different texts stand for themselves, as do
    rows without an id; of rows equal in both one stays."""
    (row,) = tmp_names(docs.columns, "row")
    ident = F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("t")).cast("binary")
    named = docs.withColumn(row, F.concat(ident, F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))))
    # the smallest id first, ids before texts: struct order, nulls last
    order = F.struct(F.col(key).isNull().alias("a"), F.col(key).alias("b"), F.col(row).alias("c"))
    groups = near_duplicates(named.select(order.alias("id"), F.col(text).alias("t")), "id", "t", shingle)
    kept = groups.select(F.col("component_id.c").alias(row)).distinct()
    return named.join(kept, row, "left_semi").dropDuplicates([row]).drop(row)
