"""Functions on code tuples, tokens and their slots."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL_CODE = 256


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pack_digits(codes, group: int = 2, base: int = 256) -> Column:
    """Neighbouring digits as one number. A digit outside 0..base-1, or a rest, raises."""
    codes = col(codes)
    bad = F.exists(codes, lambda d: (d < 0) | (d >= base)) | (F.size(codes) % group != 0)
    starts = F.sequence(F.lit(0), (F.size(codes) / group).cast("int") - 1)
    packed = F.transform(starts, lambda k: F.aggregate(F.slice(codes, k * group + 1, group), F.lit(0).cast("long"), lambda a, d: a * base + d))
    return F.when(bad, F.raise_error(F.lit("digit out of range")).cast("array<bigint>")).when(F.size(codes) == 0, F.array().cast("array<bigint>")).otherwise(packed)


def pack_pairs(codes, pairs: list[tuple[int, int]], base: int = 256) -> Column:
    """Chosen slot pairs (left, right) as one number each."""
    codes = col(codes)
    return F.array(*[(F.get(codes, F.lit(a)).cast("long") * base + F.get(codes, F.lit(b))) for a, b in pairs])


def with_null_slots(codes, keep: int, nulls: int, null_code: int = NULL_CODE) -> Column:
    """The first codes, constant nulls, and the last value (the collision digit)."""
    codes = col(codes)
    return F.concat(F.slice(codes, 1, keep), F.array_repeat(F.lit(null_code), nulls), F.slice(codes, -1, 1))


def pair_low(a, b) -> Column:
    return F.least(col(a), col(b))


def pair_high(a, b) -> Column:
    return F.greatest(col(a), col(b))


def ratio(a, b) -> Column:
    """0 where the denominator is 0 or null."""
    return F.coalesce(F.try_divide(col(a).cast("double"), col(b).cast("double")), F.lit(0.0))


def discount(rank) -> Column:
    return 1.0 / F.log2(col(rank).cast("double") + 1.0)


def _has(slots: Column, values: list[int]) -> Column:
    return F.arrays_overlap(slots, F.array(*[F.lit(int(v)) for v in values])) if values else F.lit(False)


def composition(slots, text: list[int], image: list[int], hash_slot: int = -1) -> Column:
    """What an array of slots is made of: mixed, text, image, hash or unknown. The hash slot does not count
    beside text or image; slots that belong to nothing add '_with_unknown'."""
    slots = col(slots)
    t, i, h = _has(slots, text), _has(slots, image), _has(slots, [hash_slot] if hash_slot >= 0 else [])
    known = F.array(*[F.lit(int(v)) for v in [*text, *image, *([hash_slot] if hash_slot >= 0 else [])]])
    kind = F.when(t & i, "mixed").when(t, "text").when(i, "image").when(h, "hash").otherwise("unknown")
    return F.when(F.size(F.array_except(slots, known)) > 0, F.concat(kind, F.lit("_with_unknown"))).otherwise(kind)


def has_hash(slots, hash_slot: int) -> Column:
    return F.array_contains(col(slots), hash_slot) if hash_slot >= 0 else F.lit(False)


def output_label(kind) -> Column:
    """The label of a merged token's composition."""
    k = col(kind)
    names = {"text": "text_only", "image": "image_only", "mixed": "text_image", "hash": "hash_only"}
    out = k
    for name, label in names.items():
        out = F.when(k == name, label).otherwise(out)
    return out


def transition(left, right, left_hash, right_hash) -> Column:
    """The class of an unordered pair of operands, from their compositions and whether they hold the hash slot.
    A null composition (an operand that cannot be resolved) is unknown."""
    a, b = col(left), col(right)
    low, high = F.least(a, b), F.greatest(a, b)
    mixed_last = F.concat(F.when(high == "mixed", high).otherwise(low), F.lit("_"), F.when(high == "mixed", low).otherwise(high))
    return (
        F.when(a.isNull() | b.isNull(), "unknown")
        .when(left_hash | right_hash | (a == "hash") | (b == "hash"), "hash_related")
        .when(a.contains("unknown") | b.contains("unknown"), "unknown")
        .when(a == b, F.concat(a, F.lit("_"), b))
        .when((low == "image") & (high == "text"), "text_image")
        .when((low == "mixed") | (high == "mixed"), F.when(low == "mixed", F.concat(low, F.lit("_"), high)).otherwise(mixed_last))
        .otherwise(F.concat(low, F.lit("_"), high))
    )


def phase_group(name) -> Column:
    n = col(name)
    return F.when(n.isin("text_text", "image_image", "text_image", "hash_related"), n).when(n.startswith("mixed"), "mixed_related").otherwise("unknown")


def phase(step, last, bins: int) -> Column:
    """The chronological bin of a step."""
    at = F.expr("0") if bins < 1 else F.floor((col(step) - 1) * bins / F.greatest(col(last), F.lit(1)))
    return F.least(F.lit(bins - 1), F.greatest(F.lit(0), at)).cast("int")


def right_padded(tokens, width, pad: int = 0) -> Column:
    tokens = col(tokens)
    return F.concat(tokens, F.array_repeat(F.lit(pad), width - F.size(tokens)))


def attention_mask(tokens, width) -> Column:
    n = F.size(col(tokens))
    return F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), width - n))


def until(tokens, end: int) -> Column:
    """The tokens before the first end token."""
    tokens = col(tokens)
    at = F.array_position(tokens, F.lit(end))
    return F.when(at > 0, F.slice(tokens, F.lit(1), (at - 1).cast("int"))).otherwise(tokens)


def control_suffix(items, control: list[int]) -> Column:
    """A control sequence once for each item."""
    return F.flatten(F.array_repeat(F.array(*[F.lit(c) for c in control]), col(items)))


def shuffled(tokens, *key, seed: int = 2024) -> Column:
    """A permutation that depends on the seed, the key and the position alone, whatever the partitions."""
    parts = [F.lit(seed), *[col(k) for k in key]]
    order = F.transform(col(tokens), lambda t, i: F.struct(F.md5(F.concat_ws("|", *[x.cast("string") for x in (*parts, i, t)])).alias("h"), i.alias("i"), t.alias("t")))
    return F.transform(F.array_sort(order), lambda x: x["t"])
