"""Fill-in-the-middle, token counts of prefixes, and the trie of conversations against plain Python."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vigilake.llm import conversation_trie as ct
from vigilake.llm import fill_in_middle as fim
from vigilake.llm import prefix_tokens as pt
from vigilake.llm import secrets, sharding
from vigilake.llm import toxicity as tox
from vigilake.llm.fixed_values import IDENTITY_GROUPS
from vigilake.llm.parentheses import Parentheses
from vigilake.llm.rank_index import RankIndex

# ---------------------------------------------------------------- fill in the middle


def middle_by_hand(i, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * j:8 * j + 8], 16) for j in range(4)]
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return i, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def odd_texts():
    rng = random.Random(5)
    parts = ["ab", "Z", " ", "\n", "7", "ü", "漢字", "😀", "<", "P>", "<P", "", "<M>"]
    out = {i: "".join(rng.choice(parts) for _ in range(rng.randrange(40))) for i in range(300)}
    return out | {300: None, 301: "", 302: "x" * 5000, 303: "0" * 70_000, 304: "word " * 30_000, 305: "😀"}


def test_middle_is_that_of_plain_python(docs):
    texts = odd_texts()
    rows = [*texts.items(), (None, "no id"), (7, texts[7])]
    got = sorted(map(tuple, fim.fill_in_middle(docs(rows)).collect()), key=str)
    assert got == sorted((middle_by_hand(*r) for r in rows), key=str)


def test_middle_is_undone(docs):
    texts = odd_texts()
    forms = set()
    for i, _, form, _, _, output in fim.fill_in_middle(docs(texts), plain_percent=100, spm_percent=50).collect():
        assert fim.restored(output.encode(), form).decode() == (texts[i] or "")
        forms.add(form)
    assert forms == {"plain", "psm", "spm"}


def test_middle_digests(docs):
    texts = odd_texts()
    for r in fim.fill_in_middle(docs(texts), digests=True).collect():
        assert r.restored_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
        assert r.output_sha256 == hashlib.sha256(middle_by_hand(r.doc_id, texts[r.doc_id])[5].encode()).hexdigest()


@pytest.mark.parametrize("step", [2, 50, 5000])
def test_rank_index_is_exact(step):
    for seed in range(20):
        rng = np.random.default_rng(seed)
        offsets = np.cumsum(rng.integers(0, step, rng.integers(1, 9000)))
        index = RankIndex(offsets)
        ranks = np.arange(len(offsets))
        assert (index.lookup(ranks) == offsets).all()
        assert np.abs(offsets - index.predict(ranks)).max() <= 121
    assert len(RankIndex(np.arange(0, 90_000, 3)).starts) == 1


# ---------------------------------------------------------------- prefixes and tokens

PARTS = ["a", "the", "ing", " ", "  ", "\n", "\n\n", "\t", "'s", "'ll", "'", "l", "'re", "r", "1", "23", "!", "...", "<|endoftext|>", "<|endo", "漢",
         "😀", "é", "\u0558", "\ua7ce", "\x85", "\xa0", "\x1c", "\u017f", "²", "\u2028"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_str(pt.vocabulary_file())


@pytest.fixture(scope="module")
def counter():
    return pt.PrefixCounter(pt.vocabulary_file())


def prefixes(library, text):
    return [len(library.encode(text[:p], add_special_tokens=False).ids) for p in range(len(text) + 1)]


def test_every_prefix_as_the_library(counter, library):
    rng = random.Random(3)
    for _ in range(400):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 25)))
        assert [0, *np.concatenate(list(counter.counts(text)))] == prefixes(library, text), repr(text)


def test_blocks_change_nothing(counter, library, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(pt, "BLOCK", 20)
    for _ in range(200):
        text = "".join(rng.choice(PARTS) for _ in range(60))
        assert [0, *np.concatenate(list(counter.counts(text)))] == prefixes(library, text), repr(text)


def test_forgetting_changes_nothing(library, monkeypatch, prose):
    monkeypatch.setattr(pt, "REMEMBERED", 3)
    small, text = pt.PrefixCounter(pt.vocabulary_file()), prose(60)
    assert [0, *np.concatenate(list(small.counts(text)))] == prefixes(library, text)


def test_stored_counts_answer_questions(docs, library, prose):
    texts = {1: prose(40), 2: None, 3: "", 4: "漢字 and 😀 it'll", 5: "<|endoftext|>x"}
    stored = {r.doc_id: r for r in pt.prefix_table(docs(texts)).withColumns({
        "five": pt.count_at("counts", 5), "beyond": pt.count_at("counts", 10_000), "fit": pt.longest_within("counts", 4)}).collect()}
    for i, text in texts.items():
        want = prefixes(library, text or "")
        assert stored[i].counts == want and stored[i].n_bytes == len((text or "").encode())
        assert stored[i].five == (want[5] if len(want) > 5 else None) and stored[i].beyond is None
        assert stored[i].fit == max(p for p, n in enumerate(want) if n <= 4)
    counted = {r.doc_id: r for r in pt.token_counts(docs(texts), limit=4).collect()}
    for i in texts:
        assert (counted[i].n_tokens, counted[i].fit_chars) == (stored[i].counts[-1], stored[i].fit)
        assert counted[i].over_limit == (counted[i].n_tokens > 4)


def test_counts_of_odd_documents(odd, library):
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in pt.token_counts(odd).collect())
    texts = [(r.doc_id or -1, r.text or "") for r in odd.collect()]
    assert got == sorted((i, len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for i, t in texts)


def test_other_vocabularies_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        pt.PrefixCounter(pt.vocabulary_file(public_tokenizers.path("word_bpe_49k.json")))


# ---------------------------------------------------------------- conversations


def trie_by_hand(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn, role or "", text or ""))
    own = {c: [t[1:] for t in sorted(v, key=lambda t: (t[0] is not None, t[0] or 0))] for c, v in own.items()}
    rebuilt = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + v[h:]
    members, children = {}, {}
    for c, v in rebuilt.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    for k in members:
        if k:
            children.setdefault(k[:-1], []).append(k)
    leaves, saved, out = {}, {}, []
    for k in sorted(members, key=len, reverse=True):
        below = children.get(k, [])
        leaves[k] = sum(leaves[x] for x in below) if below else 1
        saved[k] = sum(saved[x] for x in below) + (len(members[k]) - 1) * (len(k[-1][1].encode()) if k else 0)
        ends = ",".join(map(str, sorted(c for c in members[k] if len(rebuilt[c]) == len(k))))
        out.append((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(below), leaves[k], saved[k],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture
def trie(spark):
    def run(rows):
        table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns(
            {c: F.lit("other") for c in ("c", "x1", "path", "depth", "kind")})
        return sorted(map(tuple, ct.conversation_trie(table.repartition(5)).collect()), key=str)

    return run


def conversations(seed, n, words):
    rng = random.Random(seed)
    return [(c, t, rng.choice("ua"), rng.choice(words) if rng.random() < 0.8 else str(rng.random()))
            for c in rng.sample(range(-50, 3 * n), n) for t in range(rng.choice([0, 1, 2, 3, 5, 9, 14]))]


def test_trie_of_odd_rows(trie):
    rows = [(None, 0, "u", "x"), (3, None, None, None), (3, 1, "a", "é"), (0, 0, "u", "q"), (0, 0, "u", "q"), (1, 0, "u", "q"), (4, 0, None, ""),
            (-7, 1, "u", "q"), (-5, 2, "b", "w"), (10, 0, "u", ""), (8, 0, "u", "lost")]
    assert trie(rows) == trie_by_hand(rows)


def test_trie_of_nothing(trie):
    assert trie([]) == [] and trie([(None, 1, "u", "x")]) == []


def test_trie_of_many(trie):
    rows = conversations(1, 400, ["x", "yy", "zé"])
    assert trie(rows) == trie_by_hand(rows)


def test_trie_in_small_shards(trie, monkeypatch):
    monkeypatch.setattr(ct, "SHARD", 7)
    monkeypatch.setattr(ct, "RUN", 20)
    rows = conversations(2, 250, ["x", "yy"])
    assert trie(rows) == trie_by_hand(rows)


def test_trie_of_copies_and_a_long_conversation(trie):
    rows = [(c, t, "u", f"m{t}") for c in range(0, 1000, 5) for t in range(12)]
    rows += [(c, t, "u", f"long{t}") for c, n in ((5001, 2000), (5002, 1900), (6000, 1500)) for t in range(n)]
    assert trie(rows) == trie_by_hand(rows)


def test_closing_parentheses():
    for seed in range(60):
        rng = random.Random(seed)
        n, bits, depth, opened, likely = rng.choice([1, 2, 70, 500, 3000]), [], 0, 0, rng.random()
        while opened < n or depth:
            up = opened < n and (not depth or rng.random() < likely)
            bits.append(up)
            depth, opened = depth + (1 if up else -1), opened + up
        stack, close = [], {}
        for i, up in enumerate(bits):
            if up:
                stack.append(i)
            else:
                close[stack.pop()] = i
        tree = Parentheses(np.array(bits))
        opens = np.flatnonzero(bits)
        assert tree.find_close(opens).tolist() == [close[i] for i in opens.tolist()]
        assert tree.pairs[-1] == sum(a and not b for a, b in zip(bits, bits[1:]))


def test_training_rows_are_bounded_by_rows(spark, docs):
    from vigilake.llm.labelled import training_rows

    rows = docs([(1, f"text {i}") for i in range(300)] + [(i, "x") for i in range(2, 60)] + [(None, "y")])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, 0), (None, 1)], "doc_id long, quality int")
    got = training_rows(rows, labels, "quality", 5, 0, most=20).collect()
    assert len(got) == 20 and len({r.id for r in got}) == 20
    every = training_rows(rows, labels, "quality", 5, 0, most=1000).collect()
    assert {r.id: r.y for r in every if r.id == 1} in ({1: 1}, {}) and len(every) == len({r.id for r in every})


def literal_head(rule):
    found = re.findall(r"[A-Za-z0-9_-]{3,}", re.sub(r"\[[^\]]*\]|\{[^}]*\}|\\x20|\(\?[^)]*\)", " ", rule.pattern))
    return max(found, key=len) if found else "0f"


def test_no_rule_is_quadratic_on_its_own_head(spark, docs):
    rules = secrets.default_rules()
    assert len(rules) > 120 and len({r.kind for r in rules}) == len(rules)
    texts = {}
    for r in rules:
        head = literal_head(r)
        texts[r.order] = (head * (100_000 // len(head) + 1))[:100_000]
    texts[1000] = "eyJ" * 350_000
    texts[1001] = "eyJabcdefghijklmn." * 60_000
    texts[1002] = "a" * 1_000_000
    began = time.time()
    got = {r["doc_id"]: r["n_spans"] for r in secrets.secret_scan(docs(texts)).collect()}
    assert time.time() - began < 240 and set(got) == set(texts)
    assert got[1000] == 0 and got[1001] > 0


def test_secret_trigrams_in_one_pass(spark):
    grams = secrets.needed(secrets.default_rules())
    rng = random.Random(3)
    texts = ["".join(rng.choice(grams + ["é", "x", "ab"]) for _ in range(n)) for n in (0, 1, 2, 30, 200)]
    texts.append("x" * (secrets.CHUNK - 1) + "ghp_" + "y" * secrets.CHUNK + "npm_")
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in rows.select("t", secrets.grams_of(F.col("t"), grams).alias("g")).collect():
        assert sorted(r["g"]) == [g for g in grams if g in r["t"]]


def test_jwt_spans(spark, docs):
    token = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N"
    got = {r["doc_id"]: r["spans"] for r in secrets.secret_scan(docs({0: token, 1: f"é {token} {token}", 2: f"x{token}"})).collect()}
    n = len(token)
    assert got[0] == f"jwt:0:{n}" and got[1] == f"jwt:2:{2 + n},jwt:{3 + n}:{3 + 2 * n}" and got[2] == ""


# ---------------------------------------------------------------- toxicity by hand


def features_by_hand(text):
    words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    names = Counter(words)
    for size in tox.PREFIXES:
        names.update(f"{size}:{w.encode()[:size].decode('latin-1')}" for w in words if len(w.encode()) > size)
    return {f: 1 + math.log1p(100 * n / max(len(words), 20)) for f, n in names.items()}


def pairs_by_hand(text):
    for sentence in re.split(r"[.!?\n]+", text.lower()):
        words = sentence.split()
        for term in set(words):
            for other in {o for g in IDENTITY_GROUPS if term in g for o in g} - {term}:
                yield " ".join(words), " ".join(other if w == term else w for w in words)


def scores_by_hand(texts, y, penalty):
    counts, pos, share = Counter(), Counter(), np.mean(y)
    vectors = [features_by_hand(t) for t in texts]
    for v, label in zip(vectors, y):
        counts.update(v.keys())
        pos.update(v.keys() if label else [])
    kept = {f for f, n in counts.items() if n >= 3}
    assert len(kept) <= tox.FEATURES
    kept |= {f for g in IDENTITY_GROUPS for t in g for f in features_by_hand(t)}
    place = {f: i for i, f in enumerate(sorted(kept))}

    def dense(rows):
        out = np.zeros((len(rows), len(place)))
        for i, v in enumerate(rows):
            for f, value in v.items():
                if f in place:
                    out[i, place[f]] = value
        return out

    found = Counter(p for t in texts for p in pairs_by_hand(t))
    assert 0 < len(found) <= tox.FIT_PAIRS
    x, a, b = dense(vectors), dense([features_by_hand(p) for p, _ in found]), dense([features_by_hand(q) for _, q in found])
    times, y = np.array(list(found.values()), float), np.array(y, float)

    def sigmoid(z):
        return 1 / (1 + np.exp(-z))

    w, bias = np.zeros(len(place)), math.log((share + 1e-3) / (1 - share + 1e-3))
    m = v = np.zeros(len(place) + 1)
    for step in range(1, 301):
        error = (sigmoid(x @ w + bias) - y) / len(y)
        p, q = sigmoid(a @ w + bias), sigmoid(b @ w + bias)
        outer = 16 * penalty * 2 * (q - p) * times / times.sum()
        g = np.append(
            x.T @ error + 1e-3 * w + b.T @ (outer * q * (1 - q)) - a.T @ (outer * p * (1 - p)),
            error.sum() + (outer * (q * (1 - q) - p * (1 - p))).sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return {t: sigmoid(sum(value * w[place[f]] for f, value in features_by_hand(t).items() if f in place) + bias) for t in texts}


def labelled(spark, docs, prose, n):
    rng, texts, rows = random.Random(8), {}, []
    for i in range(n):
        words = prose(12, i).split()
        bad = rng.random() < 0.3
        for _ in range(2 if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "scum", "moron"]))
        words.insert(rng.randrange(len(words)), "muslim" if rng.random() < (0.8 if bad else 0.1) else rng.choice(["christian", "jewish", "niño", "frau"]))
        words[5] += ". She" if i % 3 else "! He"
        texts[i] = " ".join(words)
        rows.append((i, int(bad)))
    return texts, spark.createDataFrame(rows, "doc_id long, toxic int"), dict(rows)


def test_toxicity_by_hand(spark, docs, prose):
    texts, labels, y = labelled(spark, docs, prose, 200)
    got = {r["doc_id"]: r["score"] for r in tox.toxicity(docs(texts), labels).collect()}
    fit = [i for i in texts if zlib.crc32(str(i).encode()) % 4 != 2]
    model = scores_by_hand([texts[i] for i in fit], [y[i] for i in fit], tox.PENALTY)
    assert all(abs(got[i] - model[texts[i]]) < 1e-6 for i in fit)


def test_scores_of_a_neutral_sentence_agree_for_all_members(spark, docs, prose):
    texts, labels, _ = labelled(spark, docs, prose, 400)
    group = next(g for g in IDENTITY_GROUPS if "muslim" in g and "christian" in g)
    rows = tox.training_rows(docs(texts), labels, "toxic", 4, 2, 6000)
    neutral = docs({i: f"the {t} family came home" for i, t in enumerate(group)})

    def spread(penalty):
        s = [r["score"] for r in tox.score(neutral, tox.train(rows, penalty=penalty)).collect()]
        return max(s) - min(s)

    assert spread(tox.PENALTY) < 0.5 * spread(0.0)


def test_swapped_sentences():
    got = list(tox.counterfactuals("Ein Mann, ein Haus. No people here! The BLIND man"))
    assert got == [
        ("ein mann, ein haus", "ein frau, ein haus"), ("the blind man", "the deaf man"), ("the blind man", "the disabled man"),
        ("the blind man", "the blind woman")]


def test_a_shard_is_written_by_several_tasks(spark, docs, prose, tmp_path):
    texts = [(i, prose(5 + i % 7, i)) for i in range(640)] + [(None, "no id"), (None, None)]
    sharding.write_shards(docs(texts), f"{tmp_path}/shards", shards=4)
    rows = spark.read.parquet(f"{tmp_path}/shards").select("doc_id", "shard", "slot", F.input_file_name().alias("file")).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in texts)
    for shard in range(4):
        own = [r for r in rows if r["shard"] == shard]
        assert sorted(r["slot"] for r in own) == list(range(len(own))) and len({r["file"] for r in own}) > 1
        # files hold ranges of slots that do not overlap
        ends = sorted((min(x), max(x)) for x in ([r["slot"] for r in own if r["file"] == f] for f in {r["file"] for r in own}))
        assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))
