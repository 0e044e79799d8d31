"""Text expressions: tokenizers, slugs, error signatures, intents, bullets. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns that results depend on.
FACET_STOP = """the a an and or of to in on for with from into that this
then it its is are be you your use using used make made get
put set run runs running create creates created creating write writes
writing written read reads reading file files output input value values
data line lines content contents result results task agent step steps
command commands check checks verify verifies ensure before after when
should must not no if any all new one two number numbers name
names text code directory folder path need needs want wants please
user here each every other others leaving alone keep kept also does
but was were never always only just still than both some can will
has have had did do done how why what which who there their
them they our out via per may might would could such same more
most less least very much many few now yet so up down over
under again once first last next prev previous current actually really
script scripts program programs python bash shell sh
about between against during without within across among upon toward
explain describe difference differences instead rather whether regardless""".split()
QUERY_STOP = """the a an to in of my me i do does is it its how
what why when and or for this that with can should would
please need want on at be am are was were have has get
there their from into some any all so if but not no""".split()
TOKEN = r"[a-z0-9_.\-]{2,}"
SLUG_STOP = """when a an the and or of to in with for you your is are
be that this it its if then before after because should must
always never make sure use using""".split()
ERROR_MARKERS = ("error", "exception", "traceback", "failed", "not found", "permission denied", "no such file")
ERROR_ID = r"\b[A-Z][A-Za-z]*(Error|Exception)\b|\bFATAL\b|\bCONFLICT\b|\bTraceback\b|\bE[A-Z]{3,}\b|\bexit(ed)? (code|status) ?[1-9]"
ERROR_LINE = (
    r"(?i)error|fail|fatal|conflict|exception|traceback|denied|not found|no such|exited|refused|timeout|timed out|cannot|can't|unable|invalid"
    r"|warning|killed|abort|unchanged|did not|didn't|nothing|no tests|seq scan|too many"
)
CREATIVE = r"(?i)\b(poem|haiku|song|limerick|story|essay|joke)\b|\blogo\b|to a (five|5).year.old|^\s*translate\b"
PROBLEM = (
    r"(?i)\b(errors?|fail\w*|broken|breaks?|crash\w*|exceptions?|conflicts?|stuck|hang(s|ing)?|freez\w*|slow\w*|wrong|missing|lost|refus\w*"
    r"|won'?t|can'?t|cannot|doesn'?t|does not|isn'?t|not working|no longer|stopped|timed? ?out|timeout|denied|unchanged|too many|flaky"
    r"|fix(es|ed|ing)?|repair\w*|debug\w*|troubleshoot\w*|recover\w*|restor\w*|undo|by accident|accidentally|even though)\b"
)
EXPLAIN = r"(?i)^\s*explain (how|why|what|the|me|to|this|that|a|an|in|when|where|it)\b"
CREATE = r"(?i)^\s*(please )?(write|create|design|generate|scaffold|draft|compose|bootstrap|build (me )?(a|an)\b|start (a|an) new)\b"
CREATE_HOW = (
    r"(?i)^\s*(how (do|can|should|would|could) (i|we)|how to|what('?s| is) the (best |right )?way to|help me)\s+"
    r"(write|create|design|generate|scaffold|draft|set up a new|start a new|make a new|add a new)\b"
)
PROCEDURAL = r"(?i)^\s*(how (do|can|should|would|could|to) (i|we)?|how to\b|what (do|should|can) (i|we) do|what('?s| is) the (best |right |proper )?way to|is there a way to|help me)"
WHY = r"(?i)^\s*why\b"
QUESTION = r"(?i)^\s*(what|who|when|where|which|how|is|are|does|do|can|should|could|would)\b|^\s*(recommend|suggest)\b|\bopinion\b|\?\s*$"
SECTIONS = ("preconditions", "procedure", "verification", "failure modes", "scope limits")
GENERIC = """file files script python output write create run command data
value values check verify read line lines text code result
content contents save saved into onto with from that this
txt log csv json yaml yml sh md dat ini conf
task agent shell bash before after using should must when
then correct correctly properly ensure ensures make makes sure""".split()


def _literals(words) -> Column:
    return F.array(*map(F.lit, words))


def _split_terms(text: Column, least: int, stop: list[str]) -> Column:
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    parts = F.flatten(F.transform(tokens, lambda w: F.concat(F.array(w), F.split(w, r"[_.\-]+"))))
    # A test against the list for each word is a look-up in one set; array_except would build the set for each row.
    return F.array_distinct(F.filter(parts, lambda p: (F.length(p) >= least) & ~p.isin(*stop) & ~p.rlike(r"^[0-9]+$")))


def facet_terms(text: Column) -> Column:
    """Distinct content words of at least 3 characters, identifiers with their parts; of a null or empty text, none."""
    return _split_terms(text, 3, FACET_STOP)


def query_terms(text: Column) -> Column:
    """Distinct words of a short query, of at least 2 characters, without function words."""
    return _split_terms(text, 2, QUERY_STOP)


def fts_terms(text: Column) -> Column:
    """The first 20 words of at least 3 characters for a full-text query."""
    stop = _literals("the and for with this that from into how can you please using".split())
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_]{3,}"), F.lit(0))
    return F.slice(F.filter(found, lambda w: ~F.array_contains(stop, w)), 1, 20)


def token_set(text: Column) -> Column:
    """Distinct runs of at least 3 small letters or digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]{3,}"), F.lit(0)))


def overlap_coefficient(a: Column, b: Column) -> Column:
    """Shared tokens over the smaller set; 0 if one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def error_sniff(text: Column) -> Column:
    """Whether one of the error markers stands in the first 200 characters."""
    head = F.lower(F.substring(F.coalesce(text, F.lit("")), 1, 200))
    return F.exists(_literals(ERROR_MARKERS), lambda m: F.contains(head, m))


def error_signature(text: Column, most: int = 900) -> Column:
    """The informative lines of an error: ids and paths shortened, telling lines kept with the last one, the last 8 of them."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), r"\b[0-9a-f]{7,40}\b", " ")
    clean = F.regexp_replace(clean, r"(?:/[\w.\-]+)+/([\w.\-]+)", "$1")
    lines = F.filter(F.transform(F.split(clean, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    kept = F.filter(lines, lambda x: x.rlike(ERROR_LINE) | x.rlike(ERROR_ID))
    last = F.try_element_at(lines, F.lit(-1))
    kept = F.when(last.isNull() | F.array_contains(kept, last), kept).otherwise(F.array_append(kept, last))
    tail = F.slice(kept, F.greatest(F.size(kept) - 7, F.lit(1)), F.lit(8))
    return F.right(F.array_join(tail, "\n"), F.lit(most))


def slug(text: Column) -> Column:
    """The first four words that aren't function words (or the first four), joined; at most 40 characters; 'skill' if none."""
    found = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    kept = F.filter(found, lambda w: ~F.array_contains(_literals(SLUG_STOP), w))
    kept = F.when(F.size(kept) > 0, kept).otherwise(found)
    out = F.regexp_replace(F.substring(F.array_join(F.slice(kept, 1, 4), "-"), 1, 40), "^-+|-+$", "")
    return F.when(out == "", "skill").otherwise(out)


def intent(text: Column) -> Column:
    """'creative', 'task', 'knowledge' or 'create', by the first rule that fits; null counts as empty, a task."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(t.rlike(CREATIVE), "creative")
        .when(t.rlike(ERROR_ID) | t.rlike(PROBLEM), "task")
        .when(t.rlike(EXPLAIN), "knowledge")
        .when(t.rlike(CREATE) | t.rlike(CREATE_HOW), "create")
        .when(t.rlike(PROCEDURAL) | t.rlike(WHY), "task")
        .when(t.rlike(QUESTION), "knowledge")
        .otherwise("task")
    )


def distinctive_words(triggers: Column, rule: Column) -> Column:
    """Distinct words over 3 characters of triggers and rule, without generic ones."""
    text = F.concat_ws(" ", F.array_join(F.coalesce(triggers, F.array().cast("array<string>")), " "), rule)
    found = F.transform(F.split(F.lower(text), r"[ \n\t\r]+"), lambda w: F.regexp_replace(w, r"^[.,:;()]+|[.,:;()]+$", ""))
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) > 3) & ~w.isin(*GENERIC)))
