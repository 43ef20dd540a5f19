"""IPv4 helpers as Column expressions.

P6, P7 and P27 are built from JVM-side functions; no Python per row. The sets of P28 are summed by an Arrow
function, a block of rows at a time.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_col

# A strict dotted quad; anything else (host names, IPv6) is rejected.
_QUAD = r"^([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})$"

BLOCK_BYTES = 4 << 20  # text of sets that is summed at once (at least one row)


def ip_to_long(s) -> Column:
    """Dotted quad -> 0 .. 2^32-1; '' -> 0 (the reference's default address);
    malformed text or an octet above 255 -> NULL (rejected, never resolved over DNS)."""
    s = as_col(s)
    # one regex check; the octets come from a single split
    parts = F.transform(F.split(s, r"\."), lambda p: p.cast("bigint"))
    value = F.aggregate(parts, F.lit(0).cast("bigint"), lambda acc, o: acc * 256 + o)
    ok = s.rlike(_QUAD)
    return F.when(s == "", F.lit(0).cast("bigint")).when(ok, F.when(F.forall(parts, lambda o: o <= 255), value))


def long_to_ip(n) -> Column:
    """Low 32 bits of a number as a dotted quad; a fraction is truncated first."""
    v = as_col(n).cast("bigint")
    parts = [F.shiftright(v, sh).bitwiseAND(255).cast("string") for sh in (24, 16, 8)]
    return F.concat_ws(".", *parts, v.bitwiseAND(255).cast("string"))


def _octets(quad: Column) -> Column:
    """The numbers of an address; a part that is no number becomes NULL. Trailing empty parts are dropped,
    as a JVM split does."""
    return F.transform(F.split(F.regexp_replace(quad, r"\.+$", ""), r"\."), lambda p: p.try_cast("int"))


def _similarity_of_octets(x: Column, y: Column) -> Column:
    """+1 per equal leading octet, then 1-|x-y|/256 at the first differing octet, up to the end of the shorter
    address; the whole divided by 4. NULL if an octet up to that end is no number."""
    pairs = F.slice(F.arrays_zip(x.alias("x"), y.alias("y")), 1, F.least(F.size(x), F.size(y)))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(False).alias("over"))

    def step(acc: Column, p: Column) -> Column:
        differs = p["x"] != p["y"]
        gain = F.when(differs, F.lit(1.0) - F.abs(p["x"] - p["y"]) / F.lit(256.0)).when(~differs, F.lit(1.0))
        return F.struct(F.when(acc["over"], acc["sum"]).otherwise(acc["sum"] + gain).alias("sum"),
                        (acc["over"] | F.coalesce(differs, F.lit(False))).alias("over"))

    total = F.aggregate(pairs, start, step)["sum"]
    return F.when(F.forall(pairs, lambda p: p["x"].isNotNull() & p["y"].isNotNull()), total / F.lit(4.0))


def ip_similarity(a, b) -> Column:
    """P27 on two addresses: spelled out for up to four compared octets, folded beyond."""

    def value(both: Column) -> Column:
        n = F.least(F.size(both["x"]), F.size(both["y"]))
        known, total = F.lit(True), F.lit(0.0)
        for i in reversed(range(4)):
            x, y = F.get(both["x"], F.lit(i)), F.get(both["y"], F.lit(i))
            known = (n <= i) | (x.isNotNull() & y.isNotNull() & known)
            total = F.when(n <= i, F.lit(0.0)).when(x == y, F.lit(1.0) + total).otherwise(F.lit(1.0) - F.abs(x - y) / F.lit(256.0))
        return F.when(n > 4, _similarity_of_octets(both["x"], both["y"])).when(known, total / F.lit(4.0))

    # the argument of a lambda is computed once, however often it is used
    return F.transform(F.array(F.struct(_octets(as_col(a)).alias("x"), _octets(as_col(b)).alias("y"))), value)[0]


# a number as a cast to int takes it; it has no minus, which parts the members
_NUMBER = re.compile(r"[\x00-\x20\x7f]*\+?([0-9]+)[\x00-\x20\x7f]*")
# dots at the end, or before a last line break, as `$` of a JVM pattern finds them
_LAST_DOTS = r"\.+(\r\n|[\n\r\x{85}\x{2028}\x{2029}])?$"
_NEVER = np.iinfo(np.int64).max


def _number(part: str) -> int:
    """An octet's number; -1 if it is none."""
    found = _NUMBER.fullmatch(part)
    return value if found and (value := int(found[1])) < 2**31 else -1


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _coded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = values.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _gains(row: np.ndarray, second: np.ndarray, begin: np.ndarray, length: np.ndarray, octets: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows 256 times the gain of all octet levels over all pairs of its two sets.

    A member is one entry of ``row`` (ascending), ``second`` (which set), ``begin`` and ``length`` (its octets). On each
    level the members are sorted by octet among those that share the octets before it; each meets all smaller ones of the
    other set through their number and their sum. Who shares its octets with no member of the other set is done."""
    gain, group, level = np.zeros(n, np.int64), row, 0
    while len(group):
        long = np.flatnonzero(length > level)
        v = octets[begin[long] + level]
        order = np.lexsort((v, group[long]))
        v, at = v[order], long[order]
        row, second, begin, length, group = (x[at] for x in (row, second, begin, length, group))
        if not len(group):
            break
        new = np.append(True, group[1:] != group[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(v)), 0))

        def before(x: np.ndarray) -> np.ndarray:
            """The sum of x over the earlier members of the group."""
            total = np.cumsum(x) - x
            return total - total[first]

        met = np.where(second, before(1 - second), before(second))
        np.add.at(gain, row, met * 256 - (v * met - np.where(second, before(v * (1 - second)), before(v * second))))
        group = np.cumsum(new | np.append(True, v[1:] != v[:-1])) - 1
        seconds = np.bincount(group, weights=second)
        on = ((seconds > 0) & (seconds < np.bincount(group)))[group]
        row, second, begin, length, group = (x[on] for x in (row, second, begin, length, group))
        level += 1
    return gain


def _block_sums(a: pa.Array, b: pa.Array) -> pa.Array:
    """For each row the sum of P27 over all pairs of its two sets, and the sizes of the sets; NULL if a set is NULL
    or a compared octet is no number."""
    n = len(a)
    lists = [pc.split_pattern(side, "-") for side in (a, b)]
    sides = np.concatenate([np.repeat(2 * np.arange(n) + i, _lengths(x)) for i, x in enumerate(lists)])
    codes, addresses = _coded(pa.concat_arrays([x.flatten() for x in lists]))
    side, code = np.divmod(np.unique(sides * len(addresses) + codes), max(len(addresses), 1))
    sizes = np.bincount(side, minlength=2 * n).reshape(n, 2)

    # addresses and octets are read once for each distinct text of the block
    parts = pc.split_pattern(pc.replace_substring_regex(addresses, _LAST_DOTS, r"\1"), ".")
    part, texts = _coded(parts.flatten())
    octets = np.array([_number(t) for t in texts.to_pylist()], np.int64)[part]
    length = _lengths(parts)
    begin = np.cumsum(length) - length

    # an unknown part makes the value NULL if an address of the other set is long enough to be compared with it
    unknown = np.flatnonzero(octets < 0)
    owner = np.repeat(np.arange(len(length)), length)[unknown]
    position = np.full(len(length), _NEVER)
    np.minimum.at(position, owner, unknown - begin[owner] + 1)
    longest, earliest = np.zeros(2 * n, np.int64), np.full(2 * n, _NEVER)
    np.maximum.at(longest, side, length[code])
    np.minimum.at(earliest, side, position[code])
    none = (earliest.reshape(n, 2) <= longest.reshape(n, 2)[:, ::-1]).any(axis=1) | (sizes == 0).any(axis=1)

    gain = _gains(side >> 1, side & 1, begin[code], length[code], octets, n)
    return pa.StructArray.from_arrays([pa.array(gain / 1024.0, mask=none), *(pa.array(sizes[:, i].astype(np.int32), mask=none) for i in (0, 1))],
                                      ["total", "one", "other"])


def _set_sums(a: pa.Array, b: pa.Array) -> pa.Array:
    """``_block_sums`` in blocks of rows bounded by the bytes of their texts."""
    size = sum(pc.binary_length(side).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for side in (a, b))
    block = (np.cumsum(size) - 1) // BLOCK_BYTES
    cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(a)]
    return pa.concat_arrays([_block_sums(a.slice(i, j - i), b.slice(i, j - i)) for i, j in zip(cuts, cuts[1:])])


_SET_SUMS = F.arrow_udf(_set_sums, T.StructType([T.StructField("total", T.DoubleType()), T.StructField("one", T.IntegerType()),
                                                 T.StructField("other", T.IntegerType())]))


def ip_set_similarity(a, b, normalize: bool = False) -> Column:
    """Sets written as 'ip-ip-...'. Sum of P27 over all pairs of the two sets, then
    (acc/|A| + acc/|B|)/2 as in the reference (can exceed 1); with normalize=True the sum
    is divided by |A|*|B| instead, which keeps the value in [0, 1]. NULL if a member is
    no address (P27).

    The pairs are not formed: the members of both sets are sorted octet by octet, and the sum is taken level by level
    with running counts and sums, in numpy for a block of rows at once (exact: sums of multiples of 1/1024). Both forms
    of two sets in a projection are computed from one call. As an Arrow function it cannot be used in a lambda."""
    sums = _SET_SUMS(as_col(a).cast("string"), as_col(b).cast("string"))
    acc, na, nb = sums["total"], sums["one"].cast("double"), sums["other"].cast("double")
    return acc / (na * nb) if normalize else (acc / na + acc / nb) / F.lit(2.0)
