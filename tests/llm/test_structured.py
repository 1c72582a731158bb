"""Conversation repair, vector codes and licence scans against plain versions of their contracts."""

import functools
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import codes, conversations, licences

DIR = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
SPACES = " \t\n\x0b\x0c\r"


# --- conversations ---


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        said = lambda v: " " if v is None else str(v)
        fault, role, text = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20, said(role), said(text)
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def plain_repair(rows):
    """One conversation's rows after damage -> (blank, duplicate, truncated, illegal, cost, audit, sha256)."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(SPACES)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[2][:1] or "?" for r in rows]
    legal = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}  # last initial written, and the next

    @functools.lru_cache(None)
    def best(i, last, inserted=0):
        ways = [(0, "", ())] if i == len(rows) and last in ("", "a") else []

        def add(cost, letter, now, line, to, n=0):
            c, a, lines = best(to, now, n)
            ways.append((cost + c, letter + a, (line, *lines) if line is not None else lines))

        if inserted < 3:
            for name in ("user", "assistant"):
                if (last, name[0]) in legal:
                    add(5, "I", name[0], (name, ""), i, inserted + 1)
        if i < len(rows):
            add(2, "D", last, None, i + 1)
            if faults[i] not in ("blank", "duplicate"):
                extra = 5 * (faults[i] == "truncated")
                if (last, initials[i]) in legal:
                    add(extra, "K", initials[i], (rows[i][2], rows[i][3]), i + 1)
                for name in ("user", "assistant"):
                    if (last, name[0]) in legal:
                        add(1 + extra, "R", name[0], (name, rows[i][3]), i + 1)
        return min(ways, default=(10**9, "", ()))

    for i in reversed(range(len(rows))):  # from the end, so that recursion stays shallow
        for last in ("", "s", "u", "a"):
            best(i, last)
    cost, audit, lines = best(0, "")
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    n = lambda kind: sum(f == kind for f in faults)
    return n("blank"), n("duplicate"), n("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()


def plain_op11(rows):
    after = {c: [] for c, *_ in rows}
    for r in plain_damage(rows):
        after[r[0]].append(r)
    out = {}
    for conv, mine in after.items():
        turns = {r[1] for r in mine if r[1] is not None}
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *plain_repair(mine))
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def op11(spark, path, rows):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("id", "key", "n", "symbol", "said", "of", "piece", "times", "edits")}).write.parquet(f"{path}/conversations.parquet")
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in conversations.op11_conversations(spark, str(path)).collect()}


@tables
def test_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = conversations.op11_conversations(spark, DIR).collect()
    assert {r.conv_id: tuple(r[c] for c in COLUMNS) for r in got} == plain_op11(rows) and len(got) == len({r[0] for r in rows})


def odd_rows(n, seed, convs):
    rnd = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "admin", "", None]
    texts = ["Yes.", "No", "  ", "", None, "Why?", "a. b", "end! \n", "é…", "ok "]
    return [(rnd.choice(convs), rnd.choice([None, *range(12)]), rnd.choice(roles), rnd.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("piece", [16_384, 4])
def test_odd_conversations(spark, tmp_path, monkeypatch, piece):
    """Null ids and turns, ties, repeats, blank and long conversations; and conversations in many pieces."""
    monkeypatch.setattr(conversations, "PIECE_ROWS", piece)
    rows = odd_rows(900, piece, [None, *range(60)]) + odd_rows(150, 5, [1000])
    rows += [(2000, t, "user" if t % 2 else "assistant", f"text {t}{'.' if t % 7 else ''}") for t in range(300)] + [(3000, 1, "user", "x.")] * 40 + [(4000, None, None, None)]
    assert op11(spark, tmp_path, rows) == plain_op11(rows)


def test_no_conversations(spark, tmp_path):
    assert op11(spark, tmp_path, []) == {}


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "assistant", "Hello."), (1, 2, "user", "Hi?"), (1, 3, "user", "Hi?"), (1, 4, "assistant", "Yes.")]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, times long")
    report, repaired = conversations.repair(turns)
    assert [tuple(r) for r in report.collect()] == [(1, 0, 1, 0, 2, *plain_repair(rows)[4:6])]
    assert [(r.place, r.role, r.text, r.edit) for r in repaired.orderBy("place").collect()] == [
        (0, "user", "Be brief.", "R"), (1, "assistant", "Hello.", "K"), (2, "user", "Hi?", "K"), (3, "assistant", "Yes.", "K")]


# --- vector codes ---


def plain_codes(rows, rounds=6):
    """{vec_id: (code, error, label_error)} and the codebooks' digest, by loops over whole numbers."""
    kept = [(i, label, [int(np.floor(4096 * float(c))) for c in v]) for i, v, label in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    if not kept:
        return {}, None
    d = len(kept[0][2]) // 8
    part = lambda x, p: x[p * d:(p + 1) * d]
    first = [x for _, _, x in sorted(kept)[:16]]
    books = [[part(x, p) for x in first] for p in range(8)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    choose = lambda x, book: min((away(x, e), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(8):
            groups = {}
            for _, _, x in kept:
                groups.setdefault(choose(part(x, p), books[p])[1], []).append(part(x, p))
            books[p] = [[sum(c) // len(groups[i]) for c in zip(*groups[i])] if i in groups else e for i, e in enumerate(books[p])]
    out, total = {}, {}
    for i, label, x in kept:
        found = [choose(part(x, p), books[p]) for p in range(8)]
        out[i] = ("".join(f"{e:02x}" for _, e in found), sum(dist for dist, _ in found), label)
        total[label] = total.get(label, 0) + out[i][1]
    sha = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return {i: (c, e, total[label]) for i, (c, e, label) in out.items()}, sha


def op12(spark, path, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("clash") for c in ("x", "v", "key", "width", "n", "w", "id", "error", "code")}).write.parquet(f"{path}/embeddings.parquet")
    return codes.op12_codes(spark, str(path)).collect()


@pytest.mark.parametrize("n", [5, 400])
def test_codes(spark, tmp_path, n):
    """Few and many vectors, equal ones, ties between entries, and rows that take no part."""
    rng = np.random.default_rng(n)
    rows = [(int(i) * 3, (np.round(rng.normal(size=16) * 2) / 4).tolist(), None if i % 5 == 0 else int(i) % 3) for i in rng.permutation(n)]
    rows += [(1, None, 1), (2, [float("nan")] * 16, 1), (4, [1.0, None] * 8, 1), (5, [float("inf")] * 16, None), (7, [0.0] * 16, 2)]
    want, sha = plain_codes(rows)
    got = op12(spark, tmp_path, rows)
    assert {r.vec_id: (r.code, r.error, r.label_error) for r in got} == want and {r.codebooks_sha256 for r in got} == {sha} and len(got) == n + 1


def test_odd_vectors(spark, tmp_path):
    rows = [(None, [1.0] * 8, 1), (1, [2.0] * 8, None), (1, [2.0] * 8, None), (2, [1e30] * 8, 1), (3, [], 3), (4, [1.0, 2.0, 3.0], 3)]
    got = op12(spark, tmp_path, rows)
    assert len(got) == 6 and all(r.error >= 0 and len(r.code) == 16 for r in got) and [r.code for r in got if r.vec_id == 3] == ["00" * 8]
    assert codes.compress(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))[0].collect() == []


def test_equal_average_search():
    rng = np.random.default_rng(3)
    for d, k in ((1, 1), (2, 16), (8, 16), (3, 7)):
        x, book = rng.integers(-9, 9, (500, d)), rng.integers(-9, 9, (k, d))
        book[k // 2] = book[0]
        dist = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        index, best = codes.nearest_entries(x, book)
        assert (index == dist.argmin(axis=1)).all() and (best == dist.min(axis=1)).all()


# --- licences ---


def plain_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_places(text):
    w = plain_words(text)
    return sorted((i, label) for label, phrase in licences.PHRASES for i in range(len(w)) if w[i:i + len(phrase.split())] == phrase.split())


def check_base(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        at = plain_places(texts[r.doc_id])
        labels = {label for _, label in at}
        assert (r.n_words, r.n_base, r.base_labels) == (len(plain_words(texts[r.doc_id])), len(at), ",".join(sorted(labels)))
        assert (r.first_word, r.last_word) == ((at[0][0], at[-1][0]) if at else (None, None))
        assert labels - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1 and (r.labels == "") == (r.score == 0) and r.labels == ",".join(sorted(set(r.labels.split(","))))


@tables
def test_licences(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    rows = licences.op13_licences(spark, DIR).collect()
    check_base(rows, texts)
    named = {"Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache", "Licensed under CC BY-NC 4.0.": "cc-by-nc"}
    for r in rows:
        for line, label in named.items():
            assert (line in (texts[r.doc_id] or "")) == (label in r.labels.split(",")), (r.doc_id, label)


def test_planted_licences(spark, tmp_path):
    rnd = random.Random(4)
    filler = lambda n: " ".join(rnd.choice("the of under work this software license public use any a and is free terms permission general rights by source code".split()) for _ in range(n))
    texts, planted = {}, {}
    for i in range(300):
        texts[i] = filler(rnd.randrange(0, 200))
    for i in range(300, 400):
        label, text, keys = licences.TEMPLATES[i % len(licences.TEMPLATES)]
        words = text.split()
        if i % 2 and len(words) > 12:  # a word in the middle is another, and one is added
            at = next(j for j in range(len(words)) if licences.words_in(words[j])[0] not in {w for k in keys for w in licences.words_in(k)})
            words[at] = "changed"
        texts[i], planted[i] = f"{filler(rnd.randrange(0, 60))}\n # {' '.join(words)}\n{filler(rnd.randrange(0, 60))}", label
    texts |= {400: None, 401: "", 402: "All Rights\nRESERVED all rights reserved", 403: "general public license " * 3000, 404: "CC-BY cc by CC/BY", 405: "all rights were reserved"}
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("base", "notices", "label", "n_words", "word", "n")})
    df.write.parquet(f"{tmp_path}/documents.parquet")
    rows = licences.op13_licences(spark, str(tmp_path)).collect()
    check_base(rows, texts)
    got = {r.doc_id: set(r.labels.split(",")) - {""} for r in rows}
    assert all(label in got[i] for i, label in planted.items())
    wrong = [i for i in range(300) if got[i] - {label for _, label in plain_places(texts[i])}]
    assert not wrong, wrong
    assert got[402] == {"reserved"} and got[403] == {"gpl"} and got[404] == {"cc-by"} and not got[405]
    assert licences.scan_licences(df.limit(0)).collect() == []
    again = licences.scan_licences(df.where("doc_id = 402").select(F.lit(None).cast("long").alias("doc_id"), "text").union(df.where("doc_id = 402").select("doc_id", "text"))).collect()
    assert len(again) == 2 and [x.start for x in again[0].base] == [0, 3]
