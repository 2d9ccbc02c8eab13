"""Probability vectors as ARRAY<DOUBLE> in canonical class order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonemark.schema import LABELS

EPS = 1e-9


def label_array() -> Column:
    return F.array(*[F.lit(x) for x in LABELS])


def argmax_label(probs: Column) -> Column:
    """Label of the largest entry; the first one wins a tie."""
    # `get` rather than `element_at`: the latter takes a NULL position for a value
    # when the array is a literal.
    return F.get(label_array(), (F.array_position(probs, F.array_max(probs)) - 1).cast("int"))


def soft_onehot(label: Column, confidence: Column) -> Column:
    def spread(pair: Column) -> Column:
        c = pair["c"]
        rest = (F.lit(1.0) - c) / F.lit(2.0)
        return F.array(*[F.when(pair["label"] == x, c).otherwise(rest) for x in LABELS])

    return let(F.struct(label.alias("label"), confidence.alias("c")), spread)


def from_map(probs: Column) -> Column:
    """Map to vector; a class absent from the map gets zero mass."""
    return F.array(
        *[F.coalesce(F.try_element_at(probs, F.lit(x)), F.lit(0.0)) for x in LABELS]
    )


def to_map(vector: Column) -> Column:
    return F.map_from_arrays(label_array(), vector)


def normalise(scores: Column) -> Column:
    """Map label -> score to a vector summing to one.

    Raises unless the keys are exactly the three classes.
    """
    keys_ok = F.array_sort(F.map_keys(scores)) == F.array(*[F.lit(x) for x in sorted(LABELS)])
    values = [F.try_element_at(scores, F.lit(x)) for x in LABELS]
    total = values[0] + values[1] + values[2]
    shown = F.concat_ws(",", F.map_keys(scores))
    return F.when(keys_ok, F.array(*[x / total for x in values])).otherwise(
        F.raise_error(F.concat(F.lit("labels do not match the classes: "), shown))
    )


def uniform() -> Column:
    return F.array(*[F.lit(1.0 / len(LABELS)) for _ in LABELS])


def entries(vector: Column) -> list[Column]:
    return [vector[i] for i in range(len(LABELS))]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once however often the body uses it.

    Without it a value used several times is copied into the expression each
    time, and nested uses multiply until the generated code no longer compiles.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def softmax(logits: Column) -> Column:
    """Stable softmax of a vector."""

    def rescale(exps: Column) -> Column:
        total = exps[0] + exps[1] + exps[2]
        return F.array(*[e / total for e in entries(exps)])

    def exponentials(x: Column) -> Column:
        top = F.array_max(x)
        return F.array(*[F.exp(v - top) for v in entries(x)])

    return let(let(logits, exponentials), rescale)


def clipped_log(p: Column) -> Column:
    return F.log(F.least(F.greatest(p, F.lit(EPS)), F.lit(1.0)))


def pooled_logits(
    log_a: list[Column], log_b: list[Column], weight: Column, temperature: Column
) -> list[Column]:
    return [
        (weight * x + (F.lit(1.0) - weight) * y) / temperature
        for x, y in zip(log_a, log_b, strict=True)
    ]


def fuse(a: Column, b: Column, weight: Column, temperature: Column) -> Column:
    """Log-linear pool of two vectors: weight on `a`, the rest on `b`."""

    def pool(pair: Column) -> Column:
        log_a, log_b = ([clipped_log(x) for x in entries(pair[k])] for k in ("a", "b"))
        return F.array(*pooled_logits(log_a, log_b, weight, temperature))

    return softmax(let(F.struct(a.alias("a"), b.alias("b")), pool))


def argmax_of(columns: list[Column]) -> Column:
    """Label of the largest column; the first one wins a tie."""
    top = F.greatest(*columns)
    out = F.when(columns[0] == top, LABELS[0])
    for x, label in zip(columns[1:], LABELS[1:], strict=True):
        out = out.when(x == top, label)
    return out


def prob_of(vector: Column, label: Column) -> Column:
    return F.get(vector, (F.array_position(label_array(), label) - 1).cast("int"))


def valence_proxy(vector: Column) -> Column:
    return F.element_at(vector, 3) - F.element_at(vector, 1)
