"""Column library: options, verdicts, text, penalties, confidences and interpretation bands."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CANNOT_ASSESS, MET, NA_LABEL, UNMET

CLOSE = 1e-9


def scale_of(options: Column, scale: Column) -> Column:
    """binary where there are no options, else the declared scale."""
    return F.when(options.isNull(), F.lit("binary")).otherwise(scale)


def option_value(options: Column, index: Column) -> Column:
    return F.get(options, index)["value"]


def checked_option_value(options: Column, index: Column) -> Column:
    """The option's value; an index out of range is an error."""
    ok = (index >= 0) & (index < F.size(options))
    return F.when(ok, option_value(options, index)).otherwise(F.raise_error(F.concat(F.lit("option index out of range: "), index.cast("string"))))


def normalized(label: Column) -> Column:
    return F.lower(F.regexp_replace(label, r"(?U)^\s+|\s+$", ""))


def option_by_label(options: Column, label: Column) -> Column:
    """Index of the option with the label, whatever its case and outer space; null if there is none."""
    return F.get(F.filter(options, lambda o: normalized(o["label"]) == normalized(label)), F.lit(0))["idx"]


def na_index(options: Column) -> Column:
    return F.get(F.filter(options, lambda o: o["na"]), F.lit(0))["idx"]


def worst_among(options: Column, weight: Column, candidates: Column) -> Column:
    """The candidate index that lowers the score most: least value, for a negative weight most; ties
    to the lowest index."""

    def key(i: Column) -> Column:
        v = option_value(options, i)
        return F.struct(F.when(weight < 0, -v).otherwise(v).alias("k"), i.alias("i"))

    return F.array_min(F.transform(candidates, key))["i"]


def scored_indices(options: Column) -> Column:
    return F.transform(F.filter(options, lambda o: ~o["na"]), lambda o: o["idx"])


def worst_scored(options: Column, weight: Column) -> Column:
    return worst_among(options, weight, scored_indices(options))


def with_na_option(options: Column) -> Column:
    """The options with an NA option appended where none is there; null stays null."""
    added = F.array(F.struct(F.size(options).cast("int").alias("idx"), F.lit(NA_LABEL).alias("label"), F.lit(0.0).alias("value"), F.lit(True).alias("na")))
    return F.when(F.exists(options, lambda o: o["na"]), options).otherwise(F.concat(options, added))


def snapped(options: Column, weight: Column, value: Column) -> Column:
    """Index of the scored option nearest to ``value``; ties within 1e-9 go to the worst of them."""
    far = F.transform(F.filter(options, lambda o: ~o["na"]), lambda o: F.struct(F.abs(o["value"] - value).alias("d"), o["idx"].alias("i")))
    least = F.array_min(F.transform(far, lambda x: x["d"]))
    close = F.filter(far, lambda x: x["d"] - least <= F.greatest(F.lit(CLOSE), CLOSE * x["d"]))
    return worst_among(options, weight, F.transform(close, lambda x: x["i"]))


def most_common(options: Column, weight: Column, indices: Column, weights: Column | None = None) -> Column:
    """The index of most votes, or of most weight; ties to the worst of them."""

    def total(u: Column) -> Column:
        if weights is None:
            return F.size(F.filter(indices, lambda x: x == u)).cast("double")
        return F.aggregate(F.zip_with(indices, weights, lambda i, w: F.when(i == u, w).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)

    counted = F.transform(F.array_distinct(indices), lambda u: F.struct(total(u).alias("n"), u.alias("i")))
    most = F.array_max(F.transform(counted, lambda x: x["n"]))
    return worst_among(options, weight, F.transform(F.filter(counted, lambda x: x["n"] == most), lambda x: x["i"]))


def binary_worst(weight: Column) -> Column:
    return F.when(weight < 0, F.lit(MET)).otherwise(F.lit(UNMET))


def score_value(verdict: Column, value: Column) -> Column:
    """1 for MET, an option's value for a choice, 0 for the rest."""
    return F.when(verdict == MET, 1.0).when(verdict.isNotNull(), 0.0).otherwise(F.coalesce(value, F.lit(0.0)))


def is_na(verdict: Column, na: Column) -> Column:
    return F.coalesce(verdict == CANNOT_ASSESS, F.lit(False)) | F.coalesce(na, F.lit(False))


def word_count(text: Column) -> Column:
    """Words between white space of any script."""
    return F.size(F.filter(F.split(text, r"(?U)[\s\x1c-\x1f]+"), lambda x: x != "")).cast("long")


_THINKING = r"(?is)<thinking>(.*?)</thinking>"
_OUTPUT = r"(?is)<output>(.*?)</output>"


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def has_sections(text: Column) -> Column:
    return text.rlike(_THINKING) | text.rlike(_OUTPUT)


def thinking_section(text: Column) -> Column:
    return _stripped(F.regexp_extract(text, _THINKING, 1))


def output_section(text: Column) -> Column:
    """The output section; without one, what is left beside the thinking; without either, the text."""
    return (
        F.when(text.rlike(_OUTPUT), _stripped(F.regexp_extract(text, _OUTPUT, 1)))
        .when(text.rlike(_THINKING), _stripped(F.regexp_replace(text, _THINKING, "")))
        .otherwise(text)
    )


def tagged(thinking: Column, output: Column) -> Column:
    """Sections as tagged text; without thinking, the output alone."""
    return F.when(F.coalesce(thinking, F.lit("")) == "", output).otherwise(
        F.concat(F.lit("<thinking>"), thinking, F.lit("</thinking><output>"), F.coalesce(output, F.lit("")), F.lit("</output>"))
    )


def blank_to_null(text: Column) -> Column:
    return F.when(text.rlike(r"(?U)\S"), text)


@dataclass(frozen=True)
class LengthPenalty:
    """Nothing up to ``free_budget`` words, ``penalty_at_cap`` from ``max_cap``, a power curve between."""

    free_budget: int = 6000
    max_cap: int = 8000
    penalty_at_cap: float = 0.5
    exponent: float = 1.6
    penalty_type: str = "ALL"
    count: Callable[[Column], Column] = word_count

    def __post_init__(self) -> None:
        if self.penalty_type not in ("ALL", "OUTPUT_ONLY", "THINKING_ONLY"):
            raise ValueError(f"unknown penalty_type {self.penalty_type!r}")
        if self.max_cap <= self.free_budget:
            raise ValueError("max_cap must exceed free_budget")

    def of(self, thinking: Column, output: Column) -> Column:
        text = {"ALL": F.concat_ws(" ", thinking, output), "OUTPUT_ONLY": output, "THINKING_ONLY": thinking}[self.penalty_type]
        n = self.count(F.coalesce(text, F.lit("")))
        part = (n - self.free_budget) / F.lit(float(self.max_cap - self.free_budget))
        return F.when(n <= self.free_budget, 0.0).when(n >= self.max_cap, float(self.penalty_at_cap)).otherwise(
            self.penalty_at_cap * F.pow(part, F.lit(float(self.exponent)))
        )

    def apply(self, score: Column, penalty: Column, normalize: bool = True) -> Column:
        """The score less the penalty, not below 0 if normalised; a null score stays null."""
        less = score - penalty
        return F.when(score.isNotNull(), F.greatest(F.lit(0.0), less) if normalize else less)


def selection_confidence(p: Column, k: Column) -> Column:
    """How far the probability of one of ``k`` choices is above chance, from 0 to 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (k * p - 1) / (k - 1)))


def snapped_level(value: Column, levels: Column) -> Column:
    """Nearest level index, halves to even, within the levels."""
    return F.greatest(F.lit(0), F.least(levels - 1, F.bround(value, 0).cast("int")))


def binary_answer(p_met: Column, threshold: Column, weight: Column) -> Column:
    return F.when(p_met > threshold, F.lit(MET)).when(p_met < threshold, F.lit(UNMET)).otherwise(binary_worst(weight))


def probabilities_ok(probabilities: Column, labels: Column) -> Column:
    """Whether a map gives each label, and nothing else, a probability from 0 to 1."""
    keys = F.map_keys(probabilities)
    return (F.size(keys) == F.size(labels)) & (F.size(F.array_except(labels, keys)) == 0) & F.forall(
        F.map_values(probabilities), lambda p: F.coalesce((p >= 0) & (p <= 1), F.lit(False))
    )


def _band(x: Column, cuts: list[tuple[float, str]], rest: str) -> Column:
    out = None
    for least, name in cuts:
        out = F.when(x >= least, name) if out is None else out.when(x >= least, name)
    return F.when(x.isNotNull(), out.otherwise(rest))


def correlation_band(r: Column) -> Column:
    return _band(F.abs(r), [(0.9, "very strong"), (0.7, "strong"), (0.5, "moderate"), (0.3, "weak")], "negligible")


def kappa_band(k: Column) -> Column:
    return _band(k, [(0.81, "almost perfect"), (0.61, "substantial"), (0.41, "moderate"), (0.21, "fair"), (0.0, "slight")], "poor")


def effect_band(d: Column) -> Column:
    return _band(F.abs(d), [(0.8, "large"), (0.5, "medium"), (0.2, "small")], "negligible")


def emd_band(d: Column) -> Column:
    return _band(d, [(0.20, "large"), (0.10, "moderate"), (0.05, "small")], "negligible")


def content_digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def affects(criterion_idx: Column, text: Column) -> Column:
    """Text with a tag that names the criterion, and the way back."""
    return F.concat(F.lit("[Affects: #"), criterion_idx.cast("string"), F.lit("] "), text)


def affected(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[Affects: #(\d+)\]"), 1), lambda x: x.cast("int"))
