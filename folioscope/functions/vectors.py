"""Vector expressions on array columns; arithmetic is in double.

Vectors are given as SQL text, usually a column name. A nested lambda is then one
expression string instead of hundreds of calls into the JVM.
"""

from pyspark.sql import Column, functions as F

from .. import fixed_values as V


def _double(v):
    return f"cast({v} AS array<double>)"


def _length(v):
    return f"sqrt(aggregate({v}, 0D, (total, x) -> total + x * x))"


def _let(name, value, body):
    """Evaluate ``value`` once for use in ``body``.

    An expression used inside a lambda is evaluated per element; binding it through a
    one-element array keeps a length from being recomputed for each coordinate.
    """
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _unit(v):
    scaled = "if(n > 0, transform(d, x -> x / n), d)"
    return _let("d", _double(v), _let("n", _length("d"), scaled))


def dot(a, b) -> Column:
    return F.expr(
        f"aggregate(zip_with({_double(a)}, {_double(b)}, (x, y) -> x * y), 0D, (total, x) -> total + x)"
    )


def norm(v) -> Column:
    return F.expr(_length(_double(v)))


def l2_normalize(v) -> Column:
    """Unit vector; a zero vector stays as it is."""
    return F.expr(_unit(v))


def fuse(visual, text, w_visual=V.VISUAL_WEIGHT, w_text=V.TEXT_WEIGHT) -> Column:
    """Unit vector of the weighted sum of the two unit vectors."""
    weighted = f"(x, y) -> x * {float(w_visual)!r}D + y * {float(w_text)!r}D"
    return F.expr(_unit(f"zip_with({_unit(visual)}, {_unit(text)}, {weighted})"))


def zero_if_missing(v, width=V.JOINT_WIDTH) -> Column:
    """The fallback of a failed encode: a zero vector, searchable with score 0."""
    v = F.col(v) if isinstance(v, str) else v
    return F.coalesce(v, F.expr(f"array_repeat(0F, {int(width)})"))
