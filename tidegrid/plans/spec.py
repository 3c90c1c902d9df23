"""Candidates: declarative factor queries, checked, told apart and compiled together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dsl
from ..operators import crosssection as xs
from ..operators import portfolio as pf

#: Accepted values of the choices (fixed values).
CHOICES = {"direction": ("long", "short"), "neutralization": ("none", "residual", "bucket", "family"), "bucket_policy": ("all", "large_liquid"), "weighting_modes": ("rank", "top_bottom")}
REQUIRED = ("candidate_id", "source_ids", "hypothesis", "family", "required_fields", "panel_formula", "direction", "neutralization", "bucket_policy", "weighting_modes", "generated_by")


class SpecError(ValueError):
    """A candidate that can't be run; the message names every fault."""


@dataclass(frozen=True)
class Candidate:
    candidate_id: str
    family: str
    formula: str
    direction: str = "long"
    neutralization: str = "none"
    bucket_policy: str = "all"
    weighting_modes: tuple[str, ...] = ("rank",)
    source_ids: tuple[str, ...] = ()

    @classmethod
    def of(cls, raw: dict) -> Candidate:
        """Checks a record of the eleven keys and takes it over."""
        faults = [f"{k} is missing" for k in REQUIRED if raw.get(k) in (None, "", [])]
        for k, allowed in CHOICES.items():
            got = raw.get(k) or []
            faults += [f"{k}: no {v!r}" for v in (got if isinstance(got, (list, tuple)) else [got]) if v not in allowed]
        if not isinstance(raw.get("source_ids"), (list, tuple)) or not isinstance(raw.get("required_fields"), (list, tuple)):
            faults.append("source_ids and required_fields are lists")
        elif bad := [f for f in raw["required_fields"] if f not in dsl.FIELDS]:
            faults.append(f"no fields {bad}")
        if raw.get("panel_formula"):
            try:
                dsl.parse(raw["panel_formula"])
            except dsl.ExpressionError as e:
                faults.append(str(e))
        if faults:
            raise SpecError("; ".join(faults))
        return cls(raw["candidate_id"], raw["family"], raw["panel_formula"], raw["direction"], raw["neutralization"], raw["bucket_policy"], tuple(sorted(raw["weighting_modes"])), tuple(sorted(raw["source_ids"])))

    def signal_key(self) -> tuple:
        """What decides the signal: equal keys are computed once."""
        return dsl.to_text(dsl.parse(self.formula)), self.neutralization, self.bucket_policy

    def signature(self) -> str:
        return "|".join([*self.signal_key(), self.direction, *self.weighting_modes, *self.source_ids])


def compile_signals(panel: DataFrame, candidates: list[Candidate], eligible: str | None = None, size: str = "size", least: int = 5, top: int = 15) -> tuple[DataFrame, dict[str, Column]]:
    """The panel with one column a distinct signal, and each candidate's directed signal over it.

    All expressions go through one ``dsl.evaluate``, so shared parts and their
    windows appear once in the plan.
    """
    texts = {t: f"_x{i}" for i, t in enumerate(dict.fromkeys(c.signal_key()[0] for c in candidates))}
    d = dsl.evaluate(panel, {name: text for text, name in texts.items()})
    made: dict[tuple, str] = {}
    for c in candidates:
        key = c.signal_key()
        if key not in made:
            made[key] = f"_s{len(made)}"
            spec = {"eligible": eligible, "size": size, "neutralization": c.neutralization, "bucket_policy": c.bucket_policy, "top": top, "least": least}
            d = xs.apply_controls(d, texts[key[0]], spec, made[key])
    return d, {c.candidate_id: F.col(made[c.signal_key()]) * (1.0 if c.direction == "long" else -1.0) for c in candidates}


def evaluate(panel: DataFrame, candidates: list[Candidate], ret: str, **options) -> DataFrame:
    """P&L by (candidate, mode, ts) of all candidates: weights lagged one row."""
    d, signals = compile_signals(panel, candidates, **options)
    jobs = [(c.candidate_id, m) for c in candidates for m in c.weighting_modes]
    names = []
    for i, (cid, mode) in enumerate(jobs):
        d = d.withColumn(f"_g{i}", signals[cid])
        d = pf.rank_weights(d, f"_g{i}", 5, f"_w{i}") if mode == "rank" else pf.top_bottom_weights(d, f"_g{i}", 5, 0.3, f"_w{i}")
        d = d.withColumn(f"_h{i}", pf.held(f"_w{i}")).withColumn(f"_t{i}", pf.turnover(f"_h{i}"))
        names.append(i)
    sums = [c for i in names for c in (F.coalesce(F.sum(F.col(f"_h{i}") * F.col(ret)), F.lit(0.0)).alias(f"_a{i}"), F.sum(f"_t{i}").alias(f"_b{i}"))]
    g = d.groupBy("ts").agg(*sums)  # one aggregation for all candidates
    rows = F.array(*[F.struct(F.lit(c).alias("candidate"), F.lit(m).alias("mode"), F.col(f"_a{i}").alias("gross"), F.col(f"_b{i}").alias("turnover")) for i, (c, m) in enumerate(jobs)])
    out = g.select("ts", F.explode(rows).alias("r")).select("r.*", "ts")
    return out.withColumn("net", F.col("gross") - F.col("turnover") * (pf.TAKER_BP + pf.SLIPPAGE_BP) / 1e4)
