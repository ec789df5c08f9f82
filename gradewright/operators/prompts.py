"""Prompt tables: customer text goes into a data block, never into instructions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.columns import col


def data_block(subject: Column, body: Column) -> Column:
    """Subject and body between delimiters, with the closing delimiter cut from the body."""
    return F.concat(
        F.lit(fixed.DATA_OPEN + "\nSubject: "), subject, F.lit("\n\n"),
        F.replace(body, F.lit(fixed.DATA_CLOSE), F.lit("")), F.lit("\n" + fixed.DATA_CLOSE))


def retry_note(failure: Column) -> Column:
    """Instruction appended after a rejected reply; empty on the first attempt."""
    return F.coalesce(F.concat(
        F.lit("\n\nYour previous reply did not satisfy the contract: "), failure,
        F.lit("\nReturn only the JSON object described above.")), F.lit(""))


def with_evidence(system: Column, rules: str, context: Column) -> Column:
    """System text plus evidence rules and lines, when there is any evidence."""
    block = F.concat(system, F.lit("\n\n" + rules + "\n\n<trusted_evidence>\n"),
                     F.array_join(context, "\n"), F.lit("\n</trusted_evidence>"))
    return F.when(F.coalesce(F.size(context), F.lit(0)) > 0, block).otherwise(system)


def triage_context(case_type: Column, priority: Column) -> Column:
    """What the draft stage is told about the triage decision."""
    return F.format_string(
        "Triage classified this as %s at %s priority.\n\n", case_type, priority)


def prompt_table(enquiries: DataFrame, system: str, evidence_rules: str = "",
                 triage: Column | None = None, evidence: str | None = None,
                 failure: str | None = None) -> DataFrame:
    """Add ``system_text`` and ``user_text`` for one model call per row.

    ``triage`` is the context the draft stage is given before the enquiry,
    ``evidence`` an array column of context lines, ``failure`` the previous
    rejection reason.
    """
    instructions = F.lit(system)
    if evidence is not None:
        instructions = with_evidence(instructions, evidence_rules, col(evidence))
    user = data_block(F.col("subject"), F.col("body"))
    if triage is not None:
        user = F.concat(triage, user)
    if failure is not None:
        user = F.concat(user, retry_note(col(failure)))
    return enquiries.withColumn("system_text", instructions).withColumn("user_text", user)
