"""Masking of sensitive values in what is stored."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.patterns import custom_rules, default_rules


def masked(text: Column, labels: Column, config: EngineConfig | None = None) -> Column:
    """text with every match of each fired label's rules masked, label by label in the order that they fired.

    labels: the request's fired labels, each once; those that the settings do not name as sensitive are passed over.
    """
    config = config or EngineConfig()
    rules = [*default_rules(), *custom_rules(config.custom_rules, config.validators)[0]]
    mask = config.mask.replace("\\", "\\\\").replace("$", "\\$")
    own = {label: [r for r in rules if r.label == label] for label in config.redact_labels}
    if not any(own.values()):
        return text

    def step(x: Column, label: Column) -> Column:
        out = None
        for name, found in own.items():
            if not found:
                continue
            done = x
            for r in found:
                done = F.regexp_replace(done, r.java, mask)
            out = F.when(label == name, done) if out is None else out.when(label == name, done)
        return out.otherwise(x)

    fired = F.filter(labels, lambda x: x.isin(list(own)))
    return F.when(F.size(fired) > 0, F.aggregate(fired, text, step)).otherwise(text)


def mask_all(text: Column, labels: tuple[str, ...], config: EngineConfig | None = None) -> Column:
    """text with every match of the labels' rules masked in their order, fired or not."""
    return masked(text, F.array(*map(F.lit, labels)), config)
