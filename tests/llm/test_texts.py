import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.llm import bpe, cuts, leaks, subjects

PATH = f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def theirs():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


@given(st.text(max_size=200))
@settings(max_examples=200)
def test_bpe_round_trip(text):
    c = bpe.codec(PATH)
    assert c.decode(c.encode(text)) == text


@pytest.mark.parametrize("text", ["", "<|endoftext|> a", "  two  spaces\n\tand\r\nlines ", "🎉 é​ " + "long" * 4000, "a" * 5000, "Ünïcödé 12345 don't we'll"])
def test_bpe_as_public(theirs, text):
    assert bpe.codec(PATH).encode(text) == theirs.encode(text, add_special_tokens=False).ids


def test_bpe_table(spark):
    df = spark.createDataFrame([(1, "a b", 1), (2, "", 2), (3, None, 3), (None, " ", 4), (1, "a b", 5)], "doc_id long, text string, ids int")
    got = sorted(((r.doc_id or 0, list(r.ids)) for r in bpe.encode_texts(df).collect()))
    assert got[1:] == [(1, got[1][1]), (1, got[1][1]), (2, []), (3, [])] and len(got[0][1]) == 1
    assert bpe.encode_texts(df.where("false")).count() == 0


def words(r, n, k):
    return [f"w{r.randrange(k)}" for _ in range(n)]


@pytest.mark.parametrize("seed", range(6))
def test_leaks_against_brute_force(seed):
    r = random.Random(seed)
    items = [(i, " ".join(words(r, r.randrange(5, 60), 30))) for i in range(40)] + [(90, ""), (91, "short one"), (92, None)]
    index = leaks.Index(items, 13)
    for _ in range(25):
        w = words(r, r.randrange(0, 60), 30)
        if r.random() < 0.8:
            src = r.choice(items[:40])[1].split()
            a = r.randrange(len(src))
            at = r.randrange(len(w) + 1)
            w[at:at] = src[a : a + r.randrange(8, 30)]
        text = ", ".join(w).upper()
        grams = {tuple(w[i : i + 13]) for i in range(len(w) - 12)}
        want = {i for i, t in items if t and any(tuple(t.split()[k : k + 13]) in grams for k in range(len(t.split()) - 12))}
        assert index.leaks(text) == want


def test_leaks_table(spark, monkeypatch):
    item = " ".join(f"v{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"x {item} y", 1), (1, item, 2), (2, None, 1), (None, item, 1), (3, "", 1), (4, " ".join(item.split()[:12]), 1)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, item), (7, item), (8, None), (None, item), (9, "too short")], "item_id long, text string")
    for block in (20_000, 2):
        monkeypatch.setattr(leaks, "ITEMS", block)
        assert [tuple(r) for r in leaks.leaked(docs, items).collect()] == [(1, 7)]
    assert leaks.leaked(docs, items.where("false")).count() == 0
    assert leaks.leaked(docs.where("false"), items).count() == 0


STEP = "array<struct<role:string,content:string,tool_calls:array<struct<name:string,args:string,result:string,error:string,duration_ms:int>>>>"


def test_cuts(spark):
    r = random.Random(3)
    say = lambda: f"The fix was to restart the {r.choice(['pod', 'node', 'proxy'])} in {''.join(r.choice('abcdefgh') for _ in range(8))} again. We saw the queue grow."
    rows, want = [], set()
    for i in range(400):
        text = " ".join(say() for _ in range(r.randrange(1, 6)))
        if len(text) > 200:
            text = text[:200]
            if not text.rstrip().endswith("."):  # else it was cut between two sentences
                want.add(f"t{i:03}")
        rows.append((f"t{i:03}", "limited", [("tool", None, [("bash", None, text, None, 1)])]))
    rows += [
        ("broken", "free", [("tool", None, [("bash", None, "We saw the que�", "", 1), None]), None, ("x", None, None)]),
        ("marked", "free", [("tool", None, [("bash", None, None, "The fix was to rest... (output truncated)", 1)])]),
        ("json", "free", [("tool", None, [("bash", None, '{"id": 1, "name": "a', None, 1)])]),
        ("whole", "free", [("tool", None, [("bash", None, "ok", "field a was [truncated] upstream; row kept.", 1)])]),
        ("none", None, None), (None, "free", []), ("noagent", None, [("x", None, [("bash", None, "done.", None, 1)])]),
    ]
    df = spark.createDataFrame(rows + rows[:20], f"id string, agent string, steps {STEP}")
    cut, texts, limits = cuts.cut_texts(df)
    got = {r.trace_id for r in cut.collect()}
    assert [(x.agent, x.length) for x in limits.collect()] == [("limited", 200)]
    assert want | {"broken", "marked", "json"} == got
    assert cut.count() == len(got)
    assert cuts.cut_texts(df.where("false"))[0].count() == 0


def test_subjects(spark):
    r = random.Random(4)
    about = {s: (g[0].split() + g[0].split())[:6] for s, g in subjects.TERMS.items()}
    docs, truth = [], {}
    for i in range(600):
        some = r.sample(sorted(about), r.choice([0, 1, 1, 2]))
        lines = [f"We looked at the {r.choice(about[s])} and then at the {r.choice(about[s])} once more." for s in some for _ in range(4)] + ["Lunch was late on Monday, thanks to the meeting."] * 2
        docs.append((i, " ".join(lines), "x"))
        truth[i] = set(some)
    df = spark.createDataFrame([*docs, (900, None, ""), (901, "", ""), (902, "...", ""), (None, "merge", ""), docs[0]], "doc_id long, text string, subject string")
    names = spark.createDataFrame([(s,) for s in about], "subject string")
    got: dict = {}
    for x in subjects.document_subjects(df, names).collect():
        got.setdefault(x.doc_id, set()).add(x.subject)
    hit = sum(len(got.get(i, set()) & t) for i, t in truth.items())
    assert hit >= 0.9 * sum(map(len, truth.values())) and hit >= 0.9 * sum(map(len, got.values()))
    assert not set(got) & {900, 901, 902, None}
    assert subjects.document_subjects(df.where("false"), names).count() == 0
    assert subjects.document_subjects(df, names.where("false")).count() == 0


def _sampled():
    r = np.random.default_rng(1)
    beta = r.dirichlet(np.full(300, 0.05), 20).T.astype(np.float32)
    docs = [r.choice(300, 40, p=(p := beta @ r.dirichlet(np.full(20, 0.1))) / p.sum()).tolist() for _ in range(200)]
    return beta, subjects.pack([*docs, [], [7]])


def test_subject_steps(monkeypatch):
    # The proportions lie near those of a fit that keeps all topics and is carried on to its end.
    beta, bags = _sampled()

    def proportions():
        out = np.zeros((len(bags.size), 20))
        for some, ids, counts in bags.blocks(900):
            g, *_ = subjects.infer(ids, counts, beta)
            assert np.allclose(g.sum(1), counts.sum(1) + 20 * subjects.ALPHA, rtol=1e-3)
            out[some] = g / g.sum(1, keepdims=True)
        return out

    got = proportions()
    for name, value in (("KEPT", 20), ("STEPS", 400), ("STILL", 0)):
        monkeypatch.setattr(subjects, name, value)
    assert np.abs(got - proportions()).sum(1).mean() / 2 < 0.02


def test_subject_sums():
    # The expected counts of a document's words add up to its words, however blocks are cut.
    beta, bags = _sampled()
    sums = np.zeros(beta.shape)
    subjects.expectation(bags, beta, sums)
    words = np.bincount(bags.ids, bags.counts, 300)
    assert np.allclose(sums.sum(1), words, rtol=1e-3, atol=1e-3)


def test_subject_anchors():
    # Of rows that are mixtures of five, five that span them are taken, and no more.
    r = np.random.default_rng(2)
    pure = r.normal(size=(5, 30))
    rows = np.concatenate([pure, r.dirichlet(np.full(5, 2.0), 60) @ pure])
    assert len(subjects.anchors(rows, np.ones(65), np.zeros(30), 20)) == 5


def test_no_list_in_the_fit(spark, monkeypatch):
    # The fit doesn't know the terms: without them the topics are the same, and belong to no subject.
    docs = [(i, f"We moved the {a} and the {b} once more. Then the {a} was fine.") for i in range(300) for a, b in [(("pod", "image"), ("wheel", "lockfile"), ("packet", "route"))[i % 3]]]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    one, _ = subjects.fit(df, ["containers"])
    monkeypatch.setattr(subjects, "TERMS", {"containers": ("zzz",)})
    two, _ = subjects.fit(df, ["containers"])
    assert np.allclose(one.beta, two.beta, atol=1e-4) and (two.of == -1).all()
