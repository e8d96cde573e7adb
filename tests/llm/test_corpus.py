"""op11, op12 and op13."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from seekrank.llm import chat, divergence, variants
from tests.llm.conftest import ODD, prose
from tools.compare import canon


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_source_divergence", "op13_chat_format"])
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    s, d = entry.queries()[name](spark, sf).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    assert len(s) and sorted(s.columns) == sorted(d.columns)
    assert canon(s) == canon(d)


# op11

def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(rows, vary, least_letters=7, least_n=2, times=10):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if vary and h % vary == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    n = {w: k for w, k in count.items() if len(w) >= least_letters and k >= least_n}
    out, form = set(), {}
    near = {w: [o for o in n if one_edit(w, o)] for w in n}
    for w in n:
        best = min(near[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def spelled(seed, n):
    """Texts of a few words that occur often, with edits of them that occur seldom."""
    r = random.Random(seed)
    stems = ["colouring", "straße\u00fcber", "aaaaaaaa", "paralleled", "mississippi", "encyclop\u00e6dia"]
    rows = []
    for i in range(n):
        out = []
        for w in r.choices(stems, weights=[400, 40, 4, 400, 40, 4], k=30):
            for _ in range(r.choice([0] * 12 + [1, 1, 2])):
                at, c = r.randrange(len(w)), r.choice("abelu\u00e9\u00ff")
                w = r.choice([w[:at] + c + w[at + 1:], w[:at] + w[at + 1:], w[:at] + c + w[at:]])
            out.append(w)
        rows.append((i, r.choice([" ", "\u00d8 ", "\u4e2d", "_1", "\u0100"]).join(out)))
    return rows


def answer(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_variants_against_brute_force(spark):
    rows = spelled(1, 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for vary, least in ((0, 7), (5, 7), (5, 3)):
        assert answer(variants.group_variants(docs, vary, least_letters=least)) == brute_variants(rows, vary, least)


def test_variants_in_many_passes(spark, monkeypatch):
    rows = spelled(2, 40)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_variants(rows, 0)
    monkeypatch.setattr(variants, "FILTER_BYTES", 16)
    sizes = Counter(len(w[0]) for w in want)
    plan = variants.passes(sorted(sizes.items()))
    assert len(plan) > 3 and any(parts > 1 for shards in plan for _, _, parts, _ in shards)
    assert all(sum(b for *_, b in shards) <= 2 for shards in plan)
    assert answer(variants.group_variants(docs)) == want


def test_chain_of_forms(spark):
    words = {"chainabc": 20_000, "chainabd": 2_000, "chainaxd": 200, "chainyxd": 20, "zhainyxd": 2}
    rows = [(1, " ".join(f"{w} " * n for w, n in words.items()))]
    got = answer(variants.group_variants(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {w: root for w, _, root, *_ in got} == dict.fromkeys(words, "chainabc")
    assert {w: form for w, form, *_ in got} == dict(zip(words, [None, *words]))


def test_variants_odd_rows(spark, odd, empty):
    assert answer(variants.group_variants(odd, 3, least_letters=4)) == brute_variants(ODD, 3, 4)
    assert variants.group_variants(empty).count() == 0
    long = [(1, "x" * 70_000 + " " + "x" * 69_999 + " " + "x" * 70_000), (2, "x" * 69_999)]
    got = answer(variants.group_variants(spark.createDataFrame(long, "doc_id long, text string")))
    assert {(len(w), n, k) for w, _, _, n, k, _ in got} == {(70_000, 2, 1), (69_999, 2, 1)}


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(min_size=5, max_size=5), min_size=1, max_size=6))
def test_edit_hashes(words):
    rows = np.frombuffer(b"".join(words), np.uint8).reshape(-1, 5)
    group = variants.Letters(rows)

    def hashed(w):
        return int(variants.Letters(np.frombuffer(w, np.uint8).reshape(1, -1)).hash[0])
    assert [int(h) for h in group.hash] == [hashed(w) for w in words]
    for row, at, h in zip(*group.deletions()):
        assert int(h) == hashed(words[row][:at] + words[row][at + 1:])
    for k in range(5):
        for row, c, h in zip(*group.replacements(k, np.array([0, 97, 255], np.uint8))):
            assert c > words[row][k] and int(h) == hashed(words[row][:k] + bytes((c,)) + words[row][k + 1:])


# op12

def brute_audit(rows, least, top):
    """rows: (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    found = [(lang, source, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate({c: c + 32 for c in range(65, 91)}))) for t, lang, source in rows]
    docs, count = Counter(), defaultdict(Counter)
    for lang, source, ts in found:
        docs.update((lang, t) for t in set(ts))
        count[lang, source].update(ts)
    out = set()
    for lang in {r[1] for r in rows}:
        kept = [t for (g, t), n in docs.items() if g == lang and n >= least]
        sources = sorted({r[2] for r in rows if r[1] == lang})

        def shares(c):
            whole = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10 ** 9 * (c[t] + 2) // whole for t in kept}
        p = {s: shares(count[lang, s]) for s in sources}
        q = shares(sum((count[lang, s] for s in sources), Counter()))

        def f(a, b):
            return (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            out |= {(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(pairs)}
            own = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if count[lang, s][t] and p[s][t] > q[t])[:top]
            out |= {(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(own)}
    return out


def audited(df, **how):
    rows = [tuple(r) for r in divergence.audit(df, **how).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_audit_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 4)
    monkeypatch.setattr(divergence, "TILE", 2)
    monkeypatch.setattr(divergence, "HELD", 20)
    r = random.Random(3)
    vocab = [f"t{chr(97 + i)}" for i in range(26)] + ["\u00e9t\u00e9", "\u4e2d\u6587", "A\u0301"]
    rows = [(" ".join(r.choices(vocab, weights=range(1, len(vocab) + 1), k=r.randrange(40))), r.choice(["en", "de", None]), f"s{min(r.randrange(12), 6)}") for _ in range(150)]
    rows += [("", "xx", "a"), (None, "xx", "b"), ("!!!", "xx", "b"), ("alone", "yy", "only"), ("", "en", "mute")]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(4)
    assert audited(df, least=10, top=5) == brute_audit(rows, 10, 5)


def test_audit_odd_rows(spark, odd, empty):
    rows = odd.withColumn("lang", F.when(F.col("doc_id") > 4, "en")).withColumn("source", F.when(F.col("doc_id") % 2 == 0, F.lit("hot")))
    plain = [(r["text"], r["lang"], r["source"]) for r in rows.select("text", "lang", "source").collect()]
    assert audited(rows, least=2, top=3) == brute_audit(plain, 2, 3)
    assert divergence.audit(rows.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 900)), st.sets(st.integers(0, 900)))
def test_galloping_merge(a, b):
    a, b = (np.array(sorted(x), np.uint16) for x in (a, b))
    assert divergence.gallop(a, b).tolist() == np.searchsorted(b, a).tolist()
    n = {k: np.arange(len(x), dtype=np.int64) * 7 + 1 for k, x in (("a", a), ("b", b))}
    got = divergence.merged(a, n["a"], 5000, b, n["b"], 9000, 901)
    full = {k: np.zeros(901, np.int64) for k in "ab"}
    full["a"][a], full["b"][b] = n["a"], n["b"]
    p, q = ([1 + 10 ** 9 * (int(c) + 2) // w for c in full[k]] for k, w in (("a", 5000), ("b", 9000)))
    assert got == sum((x - y) ** 2 // (x + y) for x, y in zip(p, q))


def test_shares_of_huge_counts():
    for n, whole in ((9 * 10 ** 14, 9 * 10 ** 15), (0, 1), (9 * 10 ** 15 - 2, 9 * 10 ** 15), (3, 7)):
        assert int(divergence.share(n, whole)) == 1 + 10 ** 9 * (n + 2) // whole


# op13

def brute_fold(events):
    """events: (conv_id, seq, turn, kind, role, text) -> {conv_id: [(role, text)]}, the plain way."""
    key = [lambda e, i=i: (e[i] is not None, e[i] if e[i] is not None else "") for i in range(6)]
    convs = {}
    for e in sorted(set(events), key=lambda e: tuple((k(e)[0], str(type(k(e)[1])), k(e)[1]) for k in key)):
        conv, _, turn, kind, role, text = e
        state = convs.setdefault(conv, {})
        if turn is None:
            continue
        if kind in ("open", "regenerate"):
            for t in [t for t in state if t > turn or t == turn and kind == "open"]:
                del state[t]
        if kind == "open":
            state[turn] = [role or "", text or ""]
        elif kind in ("delta", "edit", "regenerate") and turn in state:
            state[turn][1] = (state[turn][1] if kind == "delta" else "") + ((text or "") if kind != "regenerate" else "")
    return {c: [tuple(m) for _, m in sorted(s.items())] for c, s in convs.items() if s}


def folded(spark, log, path):
    chat.write_chats(log, path)
    rows = chat.read_chats(spark, path)
    out, masked = defaultdict(list), defaultdict(str)
    for r in sorted(rows.collect(), key=lambda r: r["row_no"]):
        out[r["conv_id"]] += chat.parse(r["formatted"])
        masked[r["conv_id"]] += "".join(chat.unescape(r["formatted"][a:b]) for a, b in zip(r["loss"][::2], r["loss"][1::2]))
    check_digests(rows, out)
    assert masked == {c: "".join(t for role, t in m if role == "assistant") for c, m in out.items()}
    return dict(out)


def check_digests(rows, want):
    got = {r["conv_id"]: r for r in chat.digests(rows).collect()}
    assert got.keys() == want.keys()
    for c, m in want.items():
        said = "".join(t for role, t in m if role == "assistant")
        assert got[c]["n_turns"] == len(m) and got[c]["loss_chars"] == len(said)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t}\n" for role, t in m).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()


LOG = "conv_id long, seq long, turn long, kind string, role string, text string"


def events(seed, convs, hot):
    """Random logs; conversation 0 holds ``hot`` of the events."""
    r, out = random.Random(seed), []
    for c in range(convs):
        top = -1
        for s in range(hot if c == 0 else r.randrange(12)):
            kind = r.choice(["open", "open", "delta", "delta", "delta", "delta", "edit", "regenerate"] if r.random() < 0.3 else ["open", "delta", "delta"])
            if kind == "open":
                top = top + 1 if r.random() < 0.95 else r.randrange(max(1, top + 1))
            turn = top if kind == "open" or r.random() < 0.7 else r.randrange(max(1, top + 3))
            out.append((c, s, turn, kind, r.choice(["user", "assistant", "a:\n\\b", None]), r.choice(["x", "### ", "</turn>\n", "\\", "##", "\U0001F600", "", None, prose(s, 5)])))
    return out


@pytest.mark.parametrize("held", [8 << 20, 40])
def test_fold_against_brute_force(spark, scratch, monkeypatch, held):
    monkeypatch.setattr(chat, "HELD", held)
    monkeypatch.setattr(chat, "ROW_CHARS", 300)
    rows = events(5, 60, 600)
    rows += rows[::7]  # delivered twice
    log = spark.createDataFrame(rows, LOG).repartition(5)
    assert folded(spark, log, f"{scratch}/chats") == brute_fold(rows)


def test_fold_odd_rows(spark, scratch):
    rows = [(None, 1, 0, "open", "user", None), (None, 2, 0, "delta", None, "x"), (1, None, 0, "open", None, "no seq"), (1, 1, None, "open", "user", "no turn"),
            (1, 2, 0, "unknown", "user", "x"), (1, 3, 0, None, "user", "x"), (2, 1, 5, "delta", None, "orphan"), (2, 2, 5, "regenerate", None, None),
            (3, 1, 0, "open", "assistant", "a" * 3_000_000), (3, 1, 0, "delta", None, "tie"), (3, 1, 0, "delta", None, "tie"), (4, 1, -3, "open", "", "")]
    log = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], LOG + ", chunk int, cut int, formatted int").repartition(3)
    assert folded(spark, log, f"{scratch}/odd") == brute_fold(rows)
    assert folded(spark, log.limit(0), f"{scratch}/none") == {}


def test_repeated_rows_are_messages(spark, scratch):
    rows = [(1, 0, "user", "same"), (1, 0, "user", "same"), (1, None, "system", None), (None, 2, None, "x"), (1, 1, "assistant", "abcdefg")]
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = {1: [("system", ""), ("user", "same"), ("user", "same"), ("assistant", "abcdefg")], None: [("", "x")]}
    assert folded(spark, chat.as_log(conversations), f"{scratch}/rows") == want
    assert chat.as_log(conversations.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(st.sampled_from("a:#\\\n</turn> ")), st.text(st.sampled_from("#\\</turn>\n ab")))))
def test_template_is_reversible(messages):
    rows = list(chat.render((i, role, text) for i, (role, text) in enumerate(messages)))
    assert [m for _, text, _ in rows for m in chat.parse(text)] == messages
    for _, text, _ in rows:
        plain = re.sub(r"\\.", "", text, flags=re.DOTALL)
        assert plain.count("</turn>") == plain.count("### ") == len(messages)
