"""Texts for judges that read prompts, built from Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _block(tag: str, text: Column) -> Column:
    """The text between tags; nothing where it is null or blank."""
    return F.when(text.rlike(r"\S"), F.concat(F.lit(f"<{tag}>\n"), text, F.lit(f"\n</{tag}>\n")))


def _joined(*parts: Column) -> Column:
    return F.array_join(F.array_compact(F.array(*parts)), "\n")


def binary_prompt(requirement: Column, weight: Column, submission: Column, prompt: Column, reference: Column, guidelines: Column) -> Column:
    kind = F.when(weight < 0, F.lit("This criterion names a fault: answer MET if the fault is there.")).otherwise(F.lit("Answer MET if the requirement is fulfilled."))
    ask = F.concat(F.lit("Criterion: "), requirement, F.lit("\n"), kind, F.lit(" Answer UNMET otherwise, or CANNOT_ASSESS if the submission does not allow a judgment."))
    return _joined(_block("guidelines", guidelines), _block("task", prompt), _block("reference", reference), _block("submission", submission), ask)


def choice_prompt(requirement: Column, options: Column, submission: Column, prompt: Column, reference: Column, guidelines: Column) -> Column:
    """Options are numbered from 1."""
    shown = F.array_join(F.transform(options, lambda o, i: F.concat((i + 1).cast("string"), F.lit(". "), o["label"])), "\n")
    ask = F.concat(F.lit("Question: "), requirement, F.lit("\nOptions:\n"), shown, F.lit("\nAnswer with the number of one option."))
    return _joined(_block("guidelines", guidelines), _block("task", prompt), _block("reference", reference), _block("submission", submission), ask)


def rubric_prompt(criteria: Column, submission: Column, prompt: Column, reference: Column, guidelines: Column) -> Column:
    """One question about a whole rubric: ``criteria`` is an array of (criterion_idx, requirement, options)."""

    def shown(c: Column) -> Column:
        options = F.array_join(F.transform(c["options"], lambda o, i: F.concat(F.lit("\n  "), (i + 1).cast("string"), F.lit(". "), o["label"])), "")
        kind = F.when(c["options"].isNull(), F.lit(" (criterion_status: MET, UNMET or CANNOT_ASSESS)")).otherwise(F.concat(F.lit(" (selected_option: a number)"), options))
        return F.concat(F.lit("c"), (c["criterion_idx"] + 1).cast("string"), F.lit(": "), c["requirement"], kind)

    ask = F.concat(
        F.lit("Criteria:\n"), F.array_join(F.transform(criteria, shown), "\n"),
        F.lit('\nAnswer with JSON: {"judgments": [{"criterion_id": "c1", "criterion_status": ..., "selected_option": ..., "explanation": ...}, ...]}, one judgment for each criterion.'),
    )
    return _joined(_block("guidelines", guidelines), _block("task", prompt), _block("reference", reference), _block("submission", submission), ask)


def with_examples(prompt: Column, examples: Column) -> Column:
    """The prompt after (submission, answer) examples."""
    shown = F.array_join(F.transform(examples, lambda e, i: F.concat(F.lit("Example "), (i + 1).cast("string"), F.lit(":\n"), e["submission"], F.lit("\nAnswer: "), e["answer"])), "\n\n")
    return F.when(F.size(examples) > 0, F.concat(shown, F.lit("\n\n"), prompt)).otherwise(prompt)


def shuffled_order(seed: int, item: Column, criterion: Column, judge: Column, options: Column) -> Column:
    """A permutation of option indices for a judge, by MD5 of (seed, item, criterion, judge, option)."""
    own = lambda i: F.md5(F.concat_ws(":", F.lit(seed), item.cast("string"), criterion.cast("string"), judge, i.cast("string")).cast("binary"))
    keyed = F.transform(options, lambda o: F.struct(own(o["idx"]).alias("h"), o["idx"].alias("i")))
    return F.transform(F.array_sort(keyed), lambda x: x["i"])


def presented(options: Column, order: Column) -> Column:
    return F.transform(order, lambda i: F.get(options, i))


def original_index(order: Column, answer: Column) -> Column:
    """Option index of an answer that counts the presented options from 1; null out of range."""
    return F.get(order, answer - 1)


def request_state(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))
