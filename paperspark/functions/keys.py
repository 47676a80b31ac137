"""Composite cache keys and model strings as Column expressions.

The typed key columns are the truth; the ``agent:model:spec:paper:label``
text is derived from them and parsed back with the label keeping any
further separators.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schemas import KEY_SEPARATOR, SUPPORTED_MODELS, VECTOR_KEY


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def cache_key(agent, model, spec, paper, label) -> Column:
    """Build the text key; NULL parts or a separator inside the first four
    parts raise (a separator there would shift the parts on parsing)."""
    parts = [_c(agent), _c(model), _c(spec), _c(paper)]
    lab = _c(label)
    bad_null = F.lit(False)
    bad_sep = F.lit(False)
    for p in parts + [lab]:
        bad_null = bad_null | p.isNull()
    for p in parts:
        bad_sep = bad_sep | p.contains(KEY_SEPARATOR)
    joined = F.concat_ws(KEY_SEPARATOR, *parts, lab)
    return (
        F.when(bad_null, F.raise_error(F.lit("cache key part is NULL")))
        .when(bad_sep, F.raise_error(F.concat(F.lit("cache key part contains '"),
                                              F.lit(KEY_SEPARATOR), F.lit("': "), joined)))
        .otherwise(joined)
    )


def parse_key(col) -> Column:
    """Struct of the five key parts; fewer than five parts raise."""
    parts = F.split(_c(col), KEY_SEPARATOR, 5)
    checked = F.when(F.size(parts) < 5, F.raise_error(
        F.concat(F.lit("invalid cache key: "), _c(col)))).otherwise(parts)
    return F.struct(*[checked.getItem(i).alias(n) for i, n in enumerate(VECTOR_KEY)])


def model_parts(col) -> Column:
    """Struct ``(model_name, model_spec, is_supported)`` of a "Name:spec"
    string; anything but exactly two parts raises. The name is lower-cased."""
    parts = F.split(_c(col), KEY_SEPARATOR)
    checked = F.when(F.size(parts) != 2, F.raise_error(
        F.concat(F.lit("model must look like 'Name:spec': "), F.coalesce(_c(col), F.lit("NULL")))
    )).otherwise(parts)
    name = F.lower(checked.getItem(0))
    return F.struct(
        name.alias("model_name"),
        checked.getItem(1).alias("model_spec"),
        name.isin(*SUPPORTED_MODELS).alias("is_supported"),
    )


def full_model_name(model_name, model_spec) -> Column:
    return F.concat(_c(model_name), F.lit(KEY_SEPARATOR), _c(model_spec))


def decompose_model(text: str) -> tuple[str, str]:
    """Driver-side check of a "Name:spec" model string: exactly two parts,
    the name lower-cased and among the supported providers."""
    parts = text.split(KEY_SEPARATOR) if isinstance(text, str) else []
    if len(parts) != 2:
        raise ValueError(f"expected a model as 'Name:spec', got {text!r}")
    name, spec = parts[0].lower(), parts[1]
    if name not in SUPPORTED_MODELS:
        raise ValueError(f"no provider called {name!r} (known: {', '.join(SUPPORTED_MODELS)})")
    return name, spec
