"""The training-data operators against brute force on small tables."""

import hashlib
import os
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexmill.llm import chat, common, decontaminate, line_dedup, near_dedup, pieces, quality, secrets, substring_dedup, toxicity, url_filter
from lexmill.operators import joins

WS = re.compile("[^\x20\x09-\x0d]+")
ODD = [(100, None), (101, ""), (102, " \n\t"), (103, "one two"), (103, "one two"), (None, "null id text with some words in it"), (104, "ÄÖ ß 😀 é \x85 x"), (105, "long " * 3000)]


def table(spark, rows, clash=True):
    df = spark.createDataFrame([(i, x, "en", f"src{(i or 0) % 3}") for i, x in rows], "doc_id long, text string, lang string, source string")
    # columns whose names an operator could want for itself
    return df.withColumns({c: F.lit(1) for c in ("key", "row", "n", "label", "score", "host", "a", "pos")}) if clash else df


def prose(rnd, n):
    return [rnd.choice(["the", "of", "cat", "dog", "Runs", "über", "a.", "to"]) + str(rnd.randrange(40)) for _ in range(n)]


def corpus(seed=1, n=60):
    rnd = random.Random(seed)
    base = prose(rnd, 120)
    rows = []
    for i in range(n):
        if i % 3 == 0:
            words = list(base)
            for _ in range(rnd.randrange(0, 9)):
                words[rnd.randrange(len(words))] = f"x{rnd.randrange(10**6)}"
        else:
            words = prose(rnd, rnd.randrange(1, 90))
            if i % 5 == 0:
                words = words[:20] + base[30:60] + words[20:]
        rows.append((i, "".join(w + rnd.choice([" ", " ", " ", "\n"]) for w in words)))
    return rows + ODD


def shingles(text):
    w = WS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("least_hot", [64, 0])
def test_near_duplicates(spark, monkeypatch, least_hot):
    monkeypatch.setattr(joins, "LEAST_HOT", least_hot)
    rows = [r for r in corpus() if r[0] != 103]
    sets = {i: shingles(x) for i, x in rows if i is not None}
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in range(len(sets)):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert links
    got = {r.doc_id: r for r in near_dedup.near_duplicates(table(spark, rows)).collect()}
    assert got.pop(None).kept
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(s), label[i], label[i] == i) for i, s in sets.items()}


def test_near_duplicates_of_repeated_rows_and_nothing(spark):
    got = near_dedup.near_duplicates(table(spark, [(2, "a b c d e f"), (2, "a b c d e f"), (1, "a b c d e f")])).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(1, 1, True), (2, 1, False), (2, 1, False)]
    assert near_dedup.near_duplicates(table(spark, [(1, "x")]).limit(0)).count() == 0


def test_near_duplicates_of_rows_with_one_doc_id(spark):
    texts = ["a b c d e f", "g h i j k l"]
    one, other = sorted(texts, key=lambda x: xxhash.xxh3_128_digest(near_dedup.shingle_set(x.encode(), common.WordHashes()).tobytes()))
    got = near_dedup.near_duplicates(table(spark, [(5, one), (5, other), (3, one), (4, other)])).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(3, 3, True), (4, 4, True), (5, 3, False), (5, 3, False)]


@pytest.mark.parametrize("least_hot", [64, 1])
def test_substring_dedup(spark, monkeypatch, least_hot):
    monkeypatch.setattr(joins, "LEAST_HOT", least_hot)
    repeated = " ".join(f"q{k}" for k in range(60))
    # ids of all sizes; rows without an id are one document
    rows = [(i if i is None or i % 4 else i + 10**15 if i % 8 else i + 9 * 10**18, x) for i, x in corpus(2, 40)] + [(3 * 10**18, repeated), (10**13, f"x {repeated}"), (None, repeated), (None, f"y {repeated} z"), (-5, f"z {repeated}")]
    seen, want = {}, []
    place = lambda i, s: ((1 << 63) - 1 if i is None else i, s)
    for i, x in rows:
        w = WS.findall(x or "")
        for s in range(len(w) - 19):
            seen[tuple(w[s : s + 20])] = min(place(i, s), seen.get(tuple(w[s : s + 20]), (1 << 64, 0)))
    for i, x in rows:
        w = WS.findall(x or "")
        gone = {s + k for s in range(len(w) - 19) if seen[tuple(w[s : s + 20])] < place(i, s) for k in range(20)}
        left = [x for k, x in enumerate(w) if k not in gone]
        want.append((i, len(w), len(gone), hashlib.sha256(" ".join(left).encode()).hexdigest()))
    got = [tuple(r) for r in substring_dedup.substring_dedup(table(spark, rows)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and sum(x[2] for x in want) > 100


def test_anchors_agree_with_a_plain_minimum():
    r = np.random.default_rng(1)
    h = r.integers(0, 1 << 63, 300, dtype=np.uint64)
    assert substring_dedup.anchors(h).tolist() == [i + int(np.argmin(h[i : i + 16])) for i in range(285)]
    assert len(substring_dedup.anchors(h[:15])) == 0


def test_anchors_of_long_texts_are_found_in_chunks(monkeypatch):
    h = np.random.default_rng(2).integers(0, 1 << 63, 3_000, dtype=np.uint64)
    h[100:200] = h[50]
    whole = substring_dedup.anchors(h).tolist()
    monkeypatch.setattr(substring_dedup, "CHUNK", 37)
    assert substring_dedup.anchors(h).tolist() == whole


def edits(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a):
        q = [i + 1]
        for j, y in enumerate(b):
            q.append(min(p[j + 1] + 1, q[j] + 1, p[j] + (x != y)))
        p = q
    return p[-1]


@pytest.mark.parametrize("most", [32, 2])
def test_line_dedup(spark, monkeypatch, most):
    monkeypatch.setattr(line_dedup, "MOST", most)
    rnd = random.Random(most)
    base = ["".join(rnd.choice("ab é") for _ in range(rnd.randrange(30, 40))).strip() for _ in range(4)]

    def edited(s, k):
        s = list(s)
        for _ in range(k):
            i, o = rnd.randrange(len(s)), rnd.randrange(3)
            s[i : i + 1] = [[], [rnd.choice("abé")], [s[i], rnd.choice("abé")]][o]
        return "".join(s)

    rows = [(d, "\n".join(edited(base[0] if rnd.random() < 0.6 else rnd.choice(base), rnd.randrange(3)) for _ in range(rnd.randrange(1, 7)))) for d in range(40)]
    flat = [(d, i, x.strip()) for d, t in rows for i, x in enumerate(t.split("\n"))]
    want = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if len(x.strip()) < 30 or not any((e, j) < (d, i) and len(z) >= 30 and abs(len(z) - len(x.strip())) < 2 and edits(z, x.strip()) < 2 for e, j, z in flat)) for d, t in rows}
    got = {r.doc_id: r._left for r in line_dedup.with_lines_left(table(spark, rows)).collect()}
    assert got == want and want != dict(rows)


def test_line_dedup_of_odd_rows(spark):
    df = table(spark, ODD)
    kept = line_dedup.deduplicated(df)
    assert kept.columns == df.columns and sorted(map(repr, (r.text for r in kept.collect()))) == sorted(repr(x) for _, x in ODD)


def test_quality(spark):
    rows = corpus(3, 40) + [(200 + k, "\n".join(["Shared line of some words here"] + [" ".join(f"w{k}_{j}_{m}" for m in range(12)) for j in range(5)] * (1 if k % 2 else 2))) for k in range(30)]
    got = quality.quality(table(spark, rows), most_docs=3, most_share=0.0).collect()
    assert len(got) == len(rows)
    want = {}
    for i, x in rows:
        w = WS.findall(x or "")
        g = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        rep = {k + o for k, y in enumerate(g) if g.count(y) > 1 for o in range(3)} if len(w) < 1000 else set(range(len(w)))
        lines = [y for y in (x or "").split("\n") if WS.search(y)]
        want.setdefault(i, set()).add((len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x or "")), len(lines) - len(set(lines)), len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w)))
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) in want[r.doc_id]
        assert not (r.base_failed and r.kept)
    shared = [r for r in got if (r.doc_id or 0) >= 200]
    assert all(r.n_frequent_words == 6 for r in shared) and any(r.kept for r in shared)


def plain_secrets(rows, most_owners=1, most_repos=3):
    """rows of (doc_id, text, repo, owner) -> the operator's rows, worked out value by value."""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    scanned, owners, repos = [], {}, {}
    for i, text, repo, owner in rows:
        text, base, values = text or "", [], {}
        for kind, found, least in (("assign", assign.finditer(text), 6), ("access", re.finditer("AKIA[A-Z0-9]+", text), 20), ("hex", re.finditer("[0-9a-f]+", text), 24)):
            for m in found:
                value, span = (m[2], m.span(2)) if kind == "assign" else (m[0], m.span())
                if len(value) >= least:
                    base.append((m.start(), ("assign", "access", "hex").index(kind), m.end(), kind))
                    values[span] = value
        for m in re.finditer("[A-Za-z0-9+/_-]{20,}", text):
            if re.search("[0-9]", m[0]) and re.search("[A-Z]", m[0]) and re.search("[a-z]", m[0]) and not any(b[0] < m.end() and m.start() < b[2] for b in base):
                values[m.span()] = m[0]
        scanned.append((i, sorted(base), values))
        for v in values.values():
            owners.setdefault(v, set()).add(owner)
            repos.setdefault(v, set()).add((owner, repo))
    out = []
    for i, base, values in scanned:
        few = {s: v for s, v in values.items() if len(owners[v]) <= most_owners and len(repos[v]) <= most_repos}
        live = [(s, 3, e, "live") for (s, e), v in few.items() if len(set(v)) >= 8]
        show = lambda spans: ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans))
        out.append((i, *(sum(b[3] == k for b in base) for k in ("assign", "access", "hex")), hashlib.sha256(show(base).encode()).hexdigest(), show(base + live), len(live), len(values) - len(few)))
    return out


def test_secrets(spark):
    key, live, copied = "AKIA" + "Z9XW8VUT7" * 2, "aB3dE5fG7hJ9kL1mN2pQ4r", "xY9zW8vU7tS6rQ5pO4nM3l"
    rnd = random.Random(8)
    rows = [(0, f"Password: 'abcdef' token=ab {live} x"), (1, f"é {key} {'0a' * 13} api-key=1"), (2, f'API_KEY="q.w/e=r" {copied}'), (3, copied), (4, "ſecret=abcdefgh"), *ODD]
    # one value in all documents of one owner, values of two owners, of many repositories, and of one
    rows += [(200 + k, " ".join(rnd.choice(["token: c3d4e5f6a7b8c9d0", f'secret = "{k % 4}f9e8d7c6b5a4{k % 4}"', f"passwd={k}hunter{k}xyz", f"{k:04d}deadbeefcafe0123456789ab", "AKIA" + "Q2W3E4R5T6Y7U8I9", "plain words"]) for _ in range(4))) for k in range(150)]
    rows = [(i, x, f"repo{(i or 0) % 7}", None if i is None else f"owner{(i or 0) % 2}" if i % 3 else "big") for i, x in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, repo string, owner string").withColumns({c: F.lit(1) for c in ("row", "v", "few", "live", "_salt", "_n")})
    got = [tuple(r) for r in secrets.secrets(df, "repo", "owner").collect()]
    want = plain_secrets(rows)
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert sum(r[6] for r in want) > 20 and sum(r[7] for r in want) > 100
    by_id = {r[0]: r for r in got}
    assert by_id[0][5] == f"assign:0:17,live:28:{28 + len(live)}" and by_id[3][5] == "" and by_id[2][7] == 1
    assert by_id[4][5] == "" and by_id[100][4] == hashlib.sha256(b"").hexdigest()


def test_chat(spark):
    control = "</s>[INST] ok [/INST]"
    texts = [control, "a\\b\n<|im_end|>\nx", "", "\\", "<s", "é😀" * 500, None]
    rows = [(1, k, "assistant" if k % 2 else "user", x) for k, x in enumerate(texts)] + [(2, 0, "us\ner\\", "x"), (2, 0, "user", "tie"), (None, 0, "user", "y"), (3, None, "assistant", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.render(chat.fold_events(chat.events_of(df)))
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    assert [(m.role, m.text) for m in got[1].messages] == [(r[2], r[3] or "") for r in rows[:7]]
    assert sorted((m.role, m.text) for m in got[2].messages) == [("us\ner\\", "x"), ("user", "tie")]
    figures = {r.conv_id: r for r in chat.digests(formatted).collect()}
    loss = "".join(r[3] or "" for r in rows[:7] if r[2] == "assistant")
    assert figures[1].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and figures[1].loss_chars == len(loss)
    for r in formatted.collect():
        assert sum(m.chars for m in r.mask) == len(r.formatted)
        at, masked = 0, ""
        for m in r.mask:
            masked += r.formatted[at : at + m.chars] if m.loss else ""
            at += m.chars
        assert re.sub(r"(?s)\\(.)", r"\1", masked) == "".join(m.text for m in got[r.conv_id].messages if m.role == "assistant")


def test_chat_log_of_a_conversation(spark):
    rows = [(1, k, ["system", "user", "assistant"][k % 3], "x" * (k * 97 % 2500)) for k in range(150)] + [(2, 0, "user", "hello"), (2, 0, "user", "hello"), (None, None, None, None)]
    log = chat.events_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    of = [r for r in sorted((r for r in log if r.conv_id == 1), key=lambda r: r.seq)]
    assert len({r.seq for r in of}) == len(of) and {r.kind for r in of} == {"open", "delta", "edit", "regenerate"}
    assert [r.message for r in of if r.kind == "open"] == list(range(150)) and of[-1].seq > chat.STRETCH
    # streams of neighbours are woven: the message changes more often than messages begin
    assert sum(x.message != y.message for x, y in zip(of, of[1:])) > 3 * 150
    assert sorted(r.message for r in log if r.conv_id == 2 and r.kind == "open") == [0, 1]


def plain_fold(log):
    """Events in the order of their conversation's sequence, one after the other."""
    messages = {}
    for conv, seq, kind, message, role, text in sorted(log, key=lambda e: (e[0], e[1], e[2], e[4] is not None, e[4] or "", e[5] or "")):
        m = messages.setdefault((conv, message), [seq, "", ""])
        m[1] = m[1] if role is None else role
        m[2] = {"delta": m[2] + (text or ""), "edit": text or "", "regenerate": ""}.get(kind, m[2])
    return sorted((c, m, *rest) for (c, m), rest in messages.items())


def test_chat_events(spark):
    log = [(1, 0, "open", 0, "user", None), (1, 4, "delta", 0, None, "b"), (1, 2, "delta", 0, None, "a"), (1, 1, "open", 1, "assistant", None), (1, 3, "delta", 1, None, "bad"), (1, 5, "regenerate", 1, None, None), (1, 6, "delta", 1, None, "go"), (1, 9, "delta", 1, None, "od"), (1, 7, "open", 2, "user", None), (1, 8, "delta", 2, None, "x"), (1, 10, "edit", 2, None, "y"), (1, 11, "ping", 2, None, "z")]
    rnd = random.Random(5)
    for conv in (2, 3):
        log += [(conv, rnd.randrange(6000), rnd.choice(["delta"] * 12 + ["edit", "regenerate", "open", "ping"]), rnd.randrange(9), rnd.choice([None] * 9 + ["user", "assistant"]), rnd.choice([None, "a", "b\n", "é"])) for _ in range(2000)]
    log = list(dict.fromkeys(log))
    rnd.shuffle(log)
    schema = "conv_id long, seq long, kind string, message long, role string, text string"
    clash = {c: F.lit(1) for c in ("stretch", "log", "part", "at")}
    df = spark.createDataFrame(log, schema)
    got = sorted((r.conv_id, r.message, r.at, r.role, r.text) for r in chat.fold_events(df.withColumns(clash)).collect())
    assert got == plain_fold(log) and [r[3:] for r in got[:3]] == [("user", "ab"), ("assistant", "good"), ("user", "y")]
    assert chat.fold_events(df.limit(0)).isEmpty() and chat.render(chat.fold_events(df.limit(0))).isEmpty()
    odd = spark.createDataFrame([(None, None, "delta", None, None, "b"), (None, 1, None, None, "user", None)], schema)
    assert [tuple(r) for r in chat.fold_events(odd).collect()] == [(None, None, 1, "user", "b")]


def test_decontamination(spark):
    items = spark.createDataFrame([(1, "In the morning Tom buys 3 kg of apples and Anna buys 5 kg of pears, then Tom gives 2 apples to Anna."), (2, "a b"), (3, None)], "item_id long, text string")
    tail = "buys 7 kg of apples and Eve buys 9 kg of pears, then {} gives 4 apples to {}. The end."
    rows = [(1, "\n Hello. In the morning Bob " + tail.format("Bob", "Eve")), (2, "In the morning Bob " + tail.format("Zed", "Bob")), (3, "In the morning the cat sat on a mat and then it was evening again"), (7, "In the morning Tom buys 3 kg of apples and Anna buys 5 kg of pears, then Tom gives 2 apples to Anna."), *ODD]
    got = sorted((r.doc_id, r.item_id, r.verbatim) for r in decontaminate.matches(table(spark, rows), items).collect())
    assert got == [(1, 1, False), (7, 1, True)]
    df = table(spark, rows)
    left = decontaminate.decontaminated(df, items)
    assert left.columns == df.columns and left.count() == len(rows) - 2
    by_shuffle = decontaminate.matches(table(spark, rows), items, broadcast_rows=0).count()
    assert by_shuffle == 2


def test_url_filter(spark):
    day = lambda d: F.to_timestamp(F.lit(f"2024-{d}"))
    rows = [(1, "https://u:p@WWW.Sub.Bad.com:80/a/b?q#f", "01-10"), (2, "https://sub.bad.com/", "03-10"), (3, "http://notbad.com/", "01-10"), (4, None, "01-10"), (5, "https://ok.org/x/y/z", "05-01"), (6, "https://ok.org/xy", "05-01"), (7, "mailto:x", "01-10"), (8, "https://bad.com", "02-01"), (9, "https://bad.com", "06-01")]
    captures = spark.createDataFrame(rows, "id long, url string, d string").withColumn("fetched", F.to_timestamp(F.concat(F.lit("2024-"), "d")))
    entries = spark.createDataFrame([("domain", "bad.com", "add", "01-01"), ("domain", "bad.com", "remove", "02-01"), ("domain", "bad.com", "add", "05-15"), ("url", "ok.org/x", "add", "04-01"), ("domain", None, "add", "01-01")], "kind string, key string, action string, d string").withColumn("at", F.to_timestamp(F.concat(F.lit("2024-"), "d")))
    for rows_limit in (1000, 0):
        got = {r.id: r.blocked for r in url_filter.as_of_filter(captures, entries, rows_limit).collect()}
        assert {i for i, b in got.items() if b} == {1, 5, 9} and len(got) == 9
    del day


@pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no tokenizer files here")
def test_pieces(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rnd = random.Random(4)
    texts = ["".join(rnd.choice(" \n\tabcdefghist_éß日😀.,-0123 THE") for _ in range(rnd.randrange(0, 90))) for _ in range(400)] + ["the " * 50, "a" * 300, "", " ", "\n\n x"]
    # units without blanks: of similar lengths, of a length of its own, of more than LONG code points
    texts += ["".join(rnd.choice("abcdeghinorst日本語é") for _ in range(n)) for n in (*range(39, 90), 700, 3_000, pieces.LONG, pieces.LONG + 1, 6_000)]
    rows = [(k, x) for k, x in enumerate(texts)] + [(900, None)]
    df = table(spark, rows).withColumns({"ids": F.lit(1), "decoded": F.lit(1)})
    got = {r.doc_id: r for r in pieces.decoded(pieces.encoded(df)).collect()}
    assert got[900].ids is None and got[900].decoded is None
    for k, x in enumerate(texts):
        assert got[k].ids == model.encode(x) and got[k].decoded == x


@pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no tokenizer files here")
def test_pieces_units_end_where_no_piece_goes_on(monkeypatch):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    encoder = pieces.Encoder(pieces.Vocabulary.load())
    # a word is encoded once, whatever stands behind it, and ideographs without blanks are no long unit
    texts = ["".join(f"{w}{mark} " for w in ("alpha", "beta", "gamma") for mark in ",;:!?"), "日本語" * 3_000]
    assert encoder.encode(texts) == [model.encode(x) for x in texts]
    assert encoder.held < 60 and max(map(len, encoder.known)) <= 8
    # units dealt over several batches, long ones beside them, and a worker that starts anew
    rnd = random.Random(9)
    texts = ["".join(rnd.choice("aeinorsth  ,.\n日é😀\0") for _ in range(rnd.randrange(0, 200))) for _ in range(300)] + [None, ""]
    for name, value in (("KEEP", 100), ("BATCH_CODES", 50), ("LONG", 12)):
        monkeypatch.setattr(pieces, name, value)
    got = [x for k in range(0, len(texts), 40) for x in encoder.encode(texts[k : k + 40])]
    assert got == [None if x is None else model.encode(x) for x in texts]


def test_toxicity_gradients():
    r = np.random.default_rng(0)
    net = toxicity.Network.fresh()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["va"] *= 5
    ids, mask, y = r.integers(0, 20, (3, toxicity.WINDOW)), np.ones((3, toxicity.WINDOW)), np.array([1.0, 0, 1])
    mask[1, 20:] = 0
    proj = net.projected(r.standard_normal((20, toxicity.WIDTH)))
    grads, d_proj = net.gradients(proj, ids, mask, y)

    def loss():
        z = net.forward(proj, ids, mask)
        return np.mean(np.log1p(np.exp(-np.where(y > 0, z, -z))))

    for array, grad, at in ((net.p["u"], grads["u"], (1, 2, 5)), (net.p["va"], grads["va"], (3,)), (proj, d_proj, (0, 4, 7))):
        old = array[at]
        array[at] = old + 1e-3
        up = loss()
        array[at] = old - 1e-3
        down = loss()
        array[at] = old
        assert abs((up - down) / 2e-3 - grad[at]) < 2e-5


def plain_score(net, text):
    """The network of one text, window by window and word by word."""
    words = [w for w in (x.strip(toxicity.EDGE) for x in text.lower().split()) if w]
    sigma = lambda x: 1 / (1 + np.exp(-x))
    h, best = toxicity.HIDDEN, -np.inf
    inputs = [net.inputs([w])[0] for w in words]
    last = max(0, len(words) - toxicity.WINDOW)
    for start in {*range(0, last, toxicity.STRIDE), last}:
        own = inputs[start : start + toxicity.WINDOW]
        states = []
        for way in (0, 1):
            state, seen = np.zeros(h), []
            for x in own[:: 1 - 2 * way]:
                x, u = x @ net.p["wx"][way] + net.p["bx"][way][0], state @ net.p["u"][way]
                z, r = (np.clip(0.25 * (x[k * h : (k + 1) * h] + u[k * h : (k + 1) * h]) + 0.5, 0, 1) for k in (0, 1))
                state = state + z * (np.tanh(x[2 * h :] + r * u[2 * h :]) - state)
                seen.append(state)
            states.append(seen[:: 1 - 2 * way])
        logit = net.p["b"][0]
        if own:
            both = np.concatenate((np.array(states[0]), np.array(states[1])), axis=1)
            weight = np.exp(both @ net.p["va"])
            logit = weight / weight.sum() @ both @ net.p["w"] + logit
        best = max(best, logit)
    return sigma(np.clip(net.slope * best + net.shift, -30, 30))


def test_toxicity_scores_equal_a_plain_network(spark):
    rnd = random.Random(6)
    net = toxicity.Network.fresh(3)
    net.p["b"][:], net.slope, net.shift = 0.3, 1.7, -0.2
    rows = [(k, " ".join(prose(rnd, n))) for k, n in enumerate([0, 1, 2, 47, 48, 49, 80, 81, 200, 1000])] + ODD
    df = table(spark, rows).withColumns({"_score": F.lit("x"), "words": F.lit(2)})
    got = toxicity.scored(df, net, column="score")
    assert sorted(got.columns) == sorted(df.columns)
    want = {(i, x): plain_score(net, (x or "").encode()) for i, x in rows}
    for r in got.collect():
        assert r._score == "x" and abs(r.score - want[r.doc_id, r.text]) < 1e-5


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables here")
def test_toxicity_on_labelled_rows_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    labelled = docs.join(labels, "doc_id", "left_semi")
    net = toxicity.fit(labelled, labels.withColumn("toxic", F.col("toxic").cast("int")))
    held = toxicity.scored(labelled.where(toxicity.held_out(F.col("doc_id"))), net).join(labels, "doc_id").collect()
    caught = [r._score >= 0.5 for r in held if r.toxic]
    alarms = [r._score >= 0.5 for r in held if not r.toxic]
    print(f"held out: {sum(caught)} of {len(caught)} toxic rows, {sum(alarms)} of {len(alarms)} clean ones")
    assert sum(caught) >= 0.8 * len(caught) and sum(alarms) <= 0.02 * len(alarms)


def test_toxicity_learns_and_covers_every_word(spark):
    rnd = random.Random(5)
    rows = [(k, " ".join([*prose(rnd, 130)][: 60 + k % 60] + (["lowei" + rnd.choice(["g", "sch", "tum"]) if k % 2 else "scum"] if k % 3 == 0 else []) + prose(rnd, 20))) for k in range(400)]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(400)] + [(9999, 1), (None, 1)], "doc_id long, toxic int")
    docs = table(spark, rows + ODD, clash=False)
    net = toxicity.fit(docs.select("doc_id", "text"), labels)
    got = toxicity.scored(docs.select("doc_id", "text"), net).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    assert len(got) == len(rows) + len(ODD) and all(0 <= r._score <= 1 for r in got)
    held = [(r._score >= 0.5) == (r.doc_id % 3 == 0) for r in got if r.held and r.doc_id is not None and r.doc_id < 400]
    assert len(held) > 40 and sum(held) / len(held) > 0.85
    for n in (0, 1, 48, 49, 80, 81, 500):
        covered = {k for s in toxicity.window_starts(n) for k in range(s, s + toxicity.WINDOW)}
        assert set(range(n)) <= covered
    assert toxicity.train([b"a"], [1]).constant == 1.0
