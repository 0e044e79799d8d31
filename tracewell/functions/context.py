"""Texts that go into a prompt: skills with their status, principles, notes, chunks, attempts and feedback."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.messages import yaml_quote

# Texts that prompts hold word for word.
UNVERIFIED = (
    "> UNVERIFIED: this skill was learned from a past failure but has not yet passed an independent\n"
    "> re-run. Treat it as a hypothesis worth trying, not as established fact.\n\n"
)
PROVISIONAL = ". (Provisional: based on a single incident; verify before relying on it.)"
HINTS = "A past failure matching this error was turned into a procedure. Follow it:\n\n"
NOTES = "Notes about this library:\n"
SEPARATOR = "\n\n---\n\n"
EVENT_MODES = {"UserPromptSubmit": "prompt", "Stop": "stop", "SubagentStop": "stop"}
PREVIOUS, FAILED, AGAIN = "Your previous attempt:\n```python\n", "\n```\nIt failed with:\n", "\nWrite a corrected version."


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def skill_md(name: Column, description: Column, body: Column, provisional: Column) -> Column:
    """A skill as a file: front matter (a provisional one says so in its description) and body."""
    weak = F.coalesce(provisional, F.lit(False)) & ~F.contains(F.lower(_text(description)), F.lit("provisional"))
    told = F.when(weak, F.concat(F.regexp_replace(_text(description), r"\.+\z", ""), F.lit(PROVISIONAL))).otherwise(_text(description))
    return F.concat(F.lit("---\nname: "), _text(name), F.lit("\ndescription: "), yaml_quote(told), F.lit("\n---\n\n"), F.regexp_replace(_text(body), r"^\s+|\s+$", ""), F.lit("\n"))


def labelled(status: Column, md: Column) -> Column:
    """A skill's text, with a note before it if the skill is a candidate."""
    return F.when(status == "candidate", F.concat(F.lit(UNVERIFIED), md)).otherwise(md)


def skills_text(texts: Column) -> Column:
    """Texts of skills in order, parted by a blank line; empty without any."""
    return F.array_join(F.coalesce(texts, F.array().cast("array<string>")), "\n\n")


def hints_text(texts: Column) -> Column:
    """The same under the heading of hints; empty without any."""
    return F.when(F.size(F.coalesce(texts, F.array().cast("array<string>"))) > 0, F.concat(F.lit(HINTS), skills_text(texts))).otherwise("")


def bullet_list(texts: Column) -> Column:
    """Texts as a list, a line each: principles, or with ``NOTES`` before it notes for an oracle."""
    return F.array_join(F.transform(F.coalesce(texts, F.array().cast("array<string>")), lambda t: F.concat(F.lit("- "), t)), "\n")


def principles_md(rules: Column) -> Column:
    """A file of principles; ``rules`` are (rule, evidence) in order."""
    lines = F.transform(rules, lambda r: F.concat(F.lit("- **"), _text(r["rule"]), F.lit("** _(evidence: "), r["evidence"].cast("string"), F.lit(" lessons)_")))
    head = F.array(*map(F.lit, ["# Principles", "", "Cross-cutting rules distilled from many lessons. Apply on every task.", ""]))
    return F.concat(F.array_join(F.concat(head, lines), "\n"), F.lit("\n"))


def chunks_text(chunks: Column) -> Column:
    """Chunks (category, title, content, url) in order, parted by rules; a URL has a line of its own."""
    one = lambda c: F.concat(F.lit("["), _text(c["category"]), F.lit("] "), _text(c["title"]), F.lit("\n"), _text(c["content"]), F.when(_text(c["url"]) != "", F.concat(F.lit("\nURL: "), c["url"])).otherwise(""))
    return F.array_join(F.transform(chunks, one), SEPARATOR)


def last_user_text(messages: Column, most: int = 6) -> Column:
    """The content of the last message of role user among the last ``most`` (role, content); empty without one."""
    tail = F.slice(messages, F.greatest(F.size(messages) - most + 1, F.lit(1)), F.lit(most))
    return _text(F.try_element_at(F.filter(tail, lambda m: m["role"] == "user"), F.lit(-1))["content"])


def prompt(doc: Column, context: Column, task: Column, previous: Column, feedback: Column) -> Column:
    """A prompt: documentation, context if there is any, task, and after a failed attempt that attempt and its feedback."""
    again = F.concat(F.lit(PREVIOUS), previous, F.lit(FAILED), _text(feedback), F.lit(AGAIN))
    parts = F.array(_text(doc), F.when(F.trim(_text(context)) != "", F.trim(context)), F.concat(F.lit("Task: "), _text(task)), F.when(_text(previous) != "", again))
    return F.array_join(F.filter(parts, lambda p: p.isNotNull()), "\n\n")


def agent_feedback(stage: Column, error: Column, wrong: str) -> Column:
    """What an agent sees of a failed attempt: the error if its code crashed, else only ``wrong``."""
    return F.when(stage == "code", _text(error)).otherwise(wrong)


def embedding_text(name: Column, description: Column, body: Column, most: int = 2000) -> Column:
    """The text that stands for a skill in an embedding: name, description and the body's first ``most`` characters."""
    return F.concat_ws("\n", _text(name), _text(description), F.left(_text(body), F.lit(most)))


def hook_mode(event: Column, argument: Column) -> Column:
    """The mode of a hook: that of its event if known, else the argument if it is a mode, else null."""
    by = F.lit(None).cast("string")
    for name, mode in EVENT_MODES.items():
        by = F.when(event == name, mode).otherwise(by)
    return F.coalesce(by, F.when(argument.isin("prompt", "stop"), argument))
