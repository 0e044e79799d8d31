"""Gates and transitions as expressions: activation, judges, security, policy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def can_activate(cleared: Column, needs_approval: Column, approved: Column) -> Column:
    """Cleared, and approved where approval is needed; nulls count as no."""
    no = F.lit(False)
    return F.coalesce(cleared, no) & (~F.coalesce(needs_approval, no) | F.coalesce(approved, no))


def judge_passes(overall: Column, verdicts: Column, flags: list[Column]) -> Column:
    """Overall 'pass', no verdict 'fail' in any place, and no flag false; a missing flag is true."""
    ok = F.coalesce(overall == "pass", F.lit(False)) & ~F.exists(F.coalesce(verdicts, F.array().cast("array<string>")), lambda v: F.coalesce(v == "fail", F.lit(False)))
    for f in flags:
        ok = ok & F.coalesce(f, F.lit(True))
    return ok


def security_clears(n_findings: Column, risky: Column, verdict: Column, severities: Column) -> Column:
    """Without risky words and findings cleared; else the verdict, unless a finding is medium or high; without a verdict,
    cleared if nothing was found."""
    serious = F.exists(F.coalesce(severities, F.array().cast("array<string>")), lambda s: s.isin("medium", "high"))
    return F.when((n_findings == 0) & ~risky, True).when(verdict.isNull(), n_findings == 0).otherwise((verdict == "clear") & ~serious)


def gate_reason(missing: Column, cleared: Column, judged: Column) -> Column:
    """The first gate that stops a skill: 'shape', 'security', 'judge', or 'candidate' if none does."""
    return F.when(F.size(missing) > 0, "shape").when(~cleared, "security").when(~judged, "judge").otherwise("candidate")


def after_eval(passed: Column, allowed: Column, tried: Column, rate: Column) -> Column:
    """Status after an evaluation: active if it passed and may be; candidate if it passed or has shown enough; else quarantine."""
    return F.when(passed & allowed, "active").when(passed, "candidate").when((tried < 2) | (rate < 0.5), "quarantine").otherwise("candidate")


def effective_thresholds(size: Column) -> Column:
    """(least, single) confidence for lessons: lower in a library of fewer than 12 skills."""
    return F.struct(F.when(size < 12, 0.3).otherwise(0.4).alias("least"), F.when(size < 12, 0.5).otherwise(0.8).alias("single"))


def merge_facets(old: Column, new: Column, anchors: Column | None = None, most: int = 8) -> Column:
    """Facets of a patch: the union of both, sorted, each cut to 40 characters, at most ``most``; entries that share a
    word with ``anchors`` are left out (for what a skill isn't for)."""
    empty = F.array().cast("array<string>")
    clip = F.filter(F.transform(F.coalesce(new, empty), lambda x: F.trim(F.left(x, F.lit(40)))), lambda x: x != "")
    if anchors is not None:
        clip = F.filter(clip, lambda x: ~F.arrays_overlap(F.split(F.lower(x), r"\W+"), anchors))
    return F.slice(F.array_sort(F.array_union(F.coalesce(old, empty), clip)), 1, most)
