"""Operators 1, 2, 4, 6, 7, 8 and 10 against brute force, exact round trips or held-out accuracy, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.llm import decontamination, language_id, licenses, line_quality, packing, queries, secrets, token_counts
from folioforge.llm.common import Words, shingles

ODD = [None, "", "   \n", "a", "é" * 3, "word " * 30, "\n\n\n", "x" * 5000, "日本語 テスト", "A.\x00B", "don't   stop"]


def table(spark, texts, **more):
    """doc_id and text, a null id, repeated rows and further columns with clashing names."""
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "null id text here"), (0, texts[0]), (0, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"score": F.lit("s"), "kept": F.lit(1), "fp": F.lit(2), "place": F.lit("p"), "spans": F.array(F.lit(1))} | {k: F.lit(v) for k, v in more.items()})


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def test_words_and_shingles_match_plain_python():
    rnd = random.Random(1)
    data = ["".join(rnd.choice("ab \n\té.") for _ in range(rnd.randint(0, 40))).encode() for _ in range(60)]
    w = Words(data)
    own = [d.split() for d in data]
    assert [w.data[a:b].tobytes() for a, b in zip(w.start, w.end, strict=True)] == [x for d in own for x in d]
    assert np.diff(w.first).tolist() == list(map(len, own))
    h = w.hashes()
    seen = {}
    for x, v in zip((x for d in own for x in d), h.tolist(), strict=True):
        assert seen.setdefault(x, v) == v
    assert len(set(seen.values())) == len(seen)
    flat = [x for d in own for x in d]
    s = shingles(h, 3).tolist()
    assert len(s) == max(0, len(flat) - 2) and len(set(s)) == len({tuple(flat[i : i + 3]) for i in range(len(s))})


# ---- 1 ---------------------------------------------------------------------------------------------------------------


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            hit |= set(range(i, i + 8))
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), n < 20 or 100 * len(hit) > 30 * n


def test_line_quality_base(spark, docs, texts):
    got = {r.doc_id: r for r in queries.op1_line_quality(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(texts)
    for i, t in texts.items():
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(t)
    rnd = random.Random(2)
    for _ in range(300):
        t = "".join(rnd.choice(["a", "b", " ", " ", "\n", "\x1c", "é", "#", "\r"]) for _ in range(rnd.randint(0, 80)))
        assert line_quality.judged(t)[:6] == brute_quality(t)


def test_line_quality_verdicts(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = line_quality.line_quality(docs).join(labels, "doc_id").filter("n_words >= 20").collect()
    assert all(r.kept for r in rows if r.quality == 1) and not any(r.kept for r in rows if r.quality == 0)
    long = "This sentence has many words in it, and it ends with a full stop as it should, for it is a real one."
    kept = line_quality.judged(f"{long}\nHome | About | Contact\nWe use cookies to improve this site.\nAnother line, no copy of the first, has as many words as that one has, and it is kept, too.")
    assert kept[6] and kept[-1] == f"{long}\nAnother line, no copy of the first, has as many words as that one has, and it is kept, too." and kept[8:11] == (0, 1, 1)


def test_line_quality_edges(spark):
    df = table(spark, ODD)
    got = line_quality.line_quality(df).collect()
    assert len(got) == df.count() and {r.doc_id for r in got if r.n_words == 0} == {0, 1, 2, 6}
    assert all(not r.kept and r.base_failed for r in got if r.n_words < 20)
    assert line_quality.line_quality(df.limit(0)).count() == 0


# ---- 2 ---------------------------------------------------------------------------------------------------------------


def symbols_of(text):
    """What is parsed: small letters, one space for each run of others, a line end after the text."""
    low = [c.lower() if len(c.lower()) == 1 else c for c in f"{text}\n"]
    return re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in low))


def brute_phrases(text, training):
    """Longest matches by substring search, block by block; a letter that never occurs is a phrase."""
    s = symbols_of(text)
    n = 0
    for lo in range(0, len(s), language_id.BLOCK):
        block, i = s[lo : lo + language_id.BLOCK], 0
        while i < len(block):
            j = i + 1
            while j < len(block) and block[i : j + 1] in training:
                j += 1
            n += 1
            i = j
    return n


def test_phrases_against_substring_search():
    rnd = random.Random(4)
    cjk = "".join(chr(0x4E00 + rnd.randrange(3500)) for _ in range(900))
    train = {"aa": language_id.letters("the cat and the hat sat on that mat " * 3), "bb": language_id.letters("der hund und die katze " * 4), "zz": language_id.letters(cjk)}
    p = language_id.Parser(train)
    cases = ["The cat", "hund, katze!", "xyz", "", "123", "the" * 200, "é der ñ", "İx \n ẞ", cjk[100:700], "a", " a "] + ["".join(rnd.choice("abcdeht  .z" + cjk[:3]) for _ in range(rnd.randint(0, 700))) for _ in range(80)]
    got, counts = p.phrases(cases)
    for x, row, n in zip(cases, got, counts, strict=True):
        if not any(c.isalpha() for c in x):
            assert n == 0 and not row.any()
        else:
            assert n == len(symbols_of(x)) and row.tolist() == [brute_phrases(x, train[lang]) for lang in p.langs]


def test_language_ties_and_wide_alphabets():
    same = language_id.letters("the cat and the hat")
    assert language_id.Parser({"b": same, "a": same, "c": same}).predict(["the hat", "x", ""])[0] == ["a", "a", "und"]
    rnd = random.Random(5)
    wide = language_id.Parser({x: "".join(chr(0x4E00 + rnd.randrange(20_000)) for _ in range(20_000)) for x in "ab"})
    assert wide.table.slots.nbytes < 50_000_000


def test_every_chosen_document_has_a_say():
    assert language_id.fair_share(["aaaa", "b", "cccccc", "dd"], 9) == "aaabcccdd" and language_id.fair_share(["ab"], 9) == "ab" and language_id.fair_share([], 9) == ""


def test_language_held_out_accuracy(spark):
    out = queries.op2_language_id(spark, "/root/testdata/sf0.01")
    rows = out.join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert {r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows} == {True}
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.99 and all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    df = table(spark, ODD, lang="xx").withColumn("lang", F.when(F.col("doc_id") == 5, "en").otherwise(F.lit(None).cast("string")))
    got = {(r.doc_id, r.lang_pred) for r in language_id.identify_languages(df).collect()}
    assert {(0, "und"), (1, "und"), (2, "und")} <= got and all(v in ("und", "en") for _, v in got)
    assert {r.lang_pred for r in language_id.identify_languages(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.identify_languages(df.limit(0)).count() == 0


# ---- 4 ---------------------------------------------------------------------------------------------------------------


def test_licenses(spark, docs, texts):
    got = {(r.doc_id, r.license) for r in queries.op4_license_scan(spark, "/root/testdata/sf0.001").collect()}
    want = set()
    for i, t in texts.items():
        words = " ".join(re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower()))
        for name in ("MIT-notice", "Apache-2.0-notice", "GPL-3.0-notice", "CC-BY-NC-4.0-notice"):
            if " ".join(re.findall("[a-z0-9]+", licenses.TEMPLATES[name].lower())) in words:
                want.add((i, name))
    assert {x for x in got if x[1].endswith("notice")} == want


def test_license_copies_with_changes(spark):
    rnd = random.Random(6)
    filler = lambda n: " ".join("".join(rnd.choice("abcdefg") for _ in range(6)) for _ in range(n))
    rows, want = [], set()
    for name in ("MIT", "Apache-2.0", "GPL-3.0-or-later", "BSD"):
        words = licenses.TEMPLATES[name].split()
        for k, changes in enumerate((0, 1, 30)):
            own = list(words)
            for c in range(changes):
                own[(c * 2 + 20) % len(own)] = "zzz"
            i = len(rows)
            rows.append((i, f"{filler(40)} {'  '.join(own).upper() if k else ' '.join(own)} {filler(40)}"))
            if changes < 2:
                want.add((i, name))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.license): r for r in licenses.scan_licenses(df).collect()}
    assert {k for k in got if not k[1].endswith("notice")} == want
    assert licenses.bands_for(0.5, 2, 0.9999) == 33
    assert licenses.scan_licenses(table(spark, ODD)).count() == 0


def told(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [set() for _ in texts]
    for r in licenses.scan_licenses(df).collect():
        got[r.doc_id].add(r.license)
    return got


def test_versions_and_families_are_told_apart(spark):
    t = licenses.default_templates()
    names = ["GPL-2.0-or-later", "GPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "BSD-3-Clause", "CC0-1.0", "EPL-2.0", "Zlib"]
    for name, got in zip(names, told(spark, *(f"before this {t[name][0]} and after" for name in names)), strict=True):
        assert {x for x in got if not x.endswith("notice")} == ({name, "BSD"} if name.startswith("BSD") else {name}), name
    two = told(spark, t["BSD-2-Clause"][0])[0]
    assert {"BSD-2-Clause", "BSD"} == two
    assert told(spark, "It is released under the terms of the MIT License, says he.", "# SPDX-License-Identifier: MIT\nx = 1", "// SPDX-License-Identifier: GPL-2.0-only", "the MIT people license nothing") == [{"MIT-notice"}, {"MIT-notice"}, {"GPL-2.0-notice"}, set()]
    assert told(spark, "It is licensed under the GNU General Public License, version 3.", "Licensed under the GNU Lesser General Public License, version 2.1 or so") == [{"GPL-3.0-notice"}, {"LGPL-2.1-notice"}]


def test_licenses_against_all_windows(spark):
    """Exact containment in every window of the grid, license by license."""
    rnd = random.Random(12)
    every = [(name, x) for name, xs in licenses.default_templates().items() for x in xs]
    w = lambda t: re.findall("[a-z0-9]+", t.lower())
    texts = []
    for _ in range(60):
        body = w(rnd.choice(every)[1]) * rnd.choice([1, 1, 2])
        for _ in range(rnd.choice([0, 1, 2, 5, 9])):
            body[rnd.randrange(len(body))] = "zz"
        lead = [rnd.choice(["the", "of", "software", "license", "qq"]) for _ in range(rnd.randint(0, 30))]
        texts.append(" ".join(lead + body[: rnd.randint(len(body) * 3 // 4, len(body))] + w(rnd.choice(every)[1])[: rnd.randint(0, 40)]))
    want = [set() for _ in texts]
    for i, t in enumerate(texts):
        words = w(t)
        for name, x in every:
            k = min(5, len(w(x)))
            sh = lambda y, k=k: [tuple(y[j : j + k]) for j in range(len(y) - k + 1)]
            own, item = sh(words), set(sh(w(x)))
            n = len(item)
            stride = max(1, n // 8)
            wide = n + stride if n > 1 else 1
            for s in range(0, len(own), stride):
                said = " " + " ".join(words[s : s + min(wide, len(own) - s) + k - 1]) + " "
                holds = lambda p, said=said: f" {' '.join(w(p))} " in said
                if len(item & set(own[s : s + wide])) >= (1.0 if name.endswith("-notice") else 0.8) * n - 1e-9 and all(map(holds, licenses.MUST.get(name, ()))) and not any(map(holds, licenses.MUST_NOT.get(name, ()))):
                    want[i].add(name)
                    break
    assert told(spark, *texts) == want and sum(map(len, want)) > 40


# ---- 6 ---------------------------------------------------------------------------------------------------------------


def test_packing_round_trip(spark, docs, texts):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    extra = table(spark, [*ODD, "İx ẞ, ’, it's <|endoftext|>. \x85 ½ Ὀδυσσεύς", " ".join(f"w{i}" for i in range(6000))]).select("doc_id", "text")
    extra = extra.withColumn("doc_id", F.coalesce("doc_id", F.lit(99)) + 1_000_000).dropDuplicates()
    all_ = docs.select("doc_id", "text").unionAll(extra).coalesce(2)
    want = {r.doc_id: [*tok.encode(r.text or "", add_special_tokens=False).ids, 1] for r in all_.collect()}
    rows = packing.pack(all_, path).collect()
    per, seq = {}, {}
    for r in rows:
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert r.ids == ids and r.doc_tokens == len(want[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        per.setdefault(r.doc_id, []).append((r.start, r.length))
        seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts, whole in [*((p, len(want[d])) for d, p in per.items()), *((p, None) for p in seq.values())]:
        at = 0
        for start, n in sorted(parts):
            assert start == at and n > 0
            at += n
        assert at == whole if whole else at <= 2048
    assert per.keys() == want.keys()
    fill = [sum(n for _, n in p) for p in seq.values()]
    assert sum(2048 - f for f in fill if f & (f - 1)) <= 0.025 * sum(fill)


def test_packing_edges(spark):
    df = table(spark, ODD)
    path = queries.tokenizer_file("word_bpe_49k.json")
    rows = packing.pack(df, path, with_ids=False).collect()
    assert sum(r.length for r in rows if r.start == 0 and r.doc_tokens == 1) == 6 and packing.pack(df.limit(0), path).count() == 0


def test_packing_with_other_tokenizers(spark, tmp_path):
    """A file with other rules gives its own ids, never those of the rules that are cut here."""
    import json

    from tokenizers import Tokenizer

    path = queries.tokenizer_file("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    cased = tmp_path / "cased.json"
    cased.write_text(json.dumps(said | {"normalizer": None}), encoding="utf-8")
    assert packing.cuts_known(said)
    df = spark.createDataFrame([(0, "Hello World, it's 2024.\n\nÉtude  x"), (1, None), (2, "")], "doc_id long, text string")
    for file in (queries.tokenizer_file("byte_bpe_50k.json"), str(cased)):
        tok = Tokenizer.from_file(file)
        want = {r.doc_id: [*tok.encode(r.text or "", add_special_tokens=False).ids, 1] for r in df.collect()}
        got = {}
        for r in packing.pack(df, file).orderBy("doc_id", "start").collect():
            got.setdefault(r.doc_id, []).extend(r.ids)
        assert got == want and want[0] != [*Tokenizer.from_file(path).encode("Hello World, it's 2024.\n\nÉtude  x", add_special_tokens=False).ids, 1]


def test_best_fit_against_scan():
    rnd = random.Random(7)
    for _ in range(200):
        lengths = np.array([rnd.randint(1, 64) for _ in range(rnd.randint(0, 60))], np.int64)
        rooms: list[int] = []
        for i in np.argsort(-lengths, kind="stable"):
            fit = [(r, -j) for j, r in enumerate(rooms) if r >= lengths[i]]
            if fit:
                rooms[-min(fit)[1]] -= lengths[i]
            else:
                rooms.append(64 - lengths[i])
        got = packing.best_fit(lengths, 64)
        assert sorted(i for w in got for i in w) == list(range(len(lengths)))
        assert sorted(64 - int(lengths[w].sum()) for w in got) == sorted(rooms)


# ---- 7 ---------------------------------------------------------------------------------------------------------------


def brute_spans(text):
    text, out = text or "", []
    for k, (pattern, group, least) in enumerate(((r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12), (r"AKIA[A-Z0-9]+", 0, 18), (r"[0-9a-f]+", 0, 16))):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text, re.ASCII) if len(m.group(group)) >= least]
    return sorted(out)


KINDS = ("assign", "access", "hex")


def test_secrets(spark, texts):
    got = {r.doc_id: r for r in queries.op7_secret_scan(spark, "/root/testdata/sf0.001").collect()}
    for i, t in texts.items():
        spans = brute_spans(t)
        said = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(s[1] == k for s in spans) for k in range(3)]
        assert got[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_index_skips_no_match():
    rnd = random.Random(8)
    pieces = ["PassWord", "token", "api_key", "APIKEY", "secret", ": ", "=", '"', "'", " ", "abcdef0123456789", "AKIA", "ABCDEFGHIJKLMNOP", "é", "ſecret", "Kkey", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36, "https://u:pass@h", "xoxb-0123456789ab", "\n"]
    scanner = secrets.Scanner()
    cases = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 12))) for _ in range(800)]
    full = [sorted((m.start(), k, m.end()) for k, (r, c) in enumerate(zip(scanner.rules, scanner.compiled, strict=True)) for m in c.finditer(x) if m.end(r.group) - m.start(r.group) >= r.least) for x in cases]
    assert scanner.found(cases) == full
    assert [[s for s in x if s[1] < 3] for x in full] == [brute_spans(x) for x in cases]
    assert secrets.trigram_query(r"[0-9a-f]+") is True and secrets.trigram_query("abcd") == frozenset({"abc", "bcd"})


def test_secret_edges(spark):
    got = secrets.find_secrets(table(spark, ODD)).collect()
    assert len(got) == len(ODD) + 3 and {r.base_sha256 for r in got} == {hashlib.sha256(b"").hexdigest()}
    assert secrets.find_secrets(table(spark, ODD).limit(0)).count() == 0


# ---- 8 ---------------------------------------------------------------------------------------------------------------


def test_token_counts(spark, texts):
    import base64

    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    n = lambda t: len(enc.encode_ordinary(t))
    for r in queries.op8_token_counts(spark, "/root/testdata/sf0.001").collect():
        t = edited = texts[r.doc_id]
        for start, end, put in token_counts.revise(t):
            edited = edited[:start] + put + edited[end:]
        assert (r.n_tokens, r.n_tokens_edited, r.n_edits) == (n(t), n(edited), len(token_counts._LONG_NUMBER.findall(t)) + (3 if t else 0))
        masked = t
        for start, end, put in token_counts.mask_long_numbers(t):
            masked = masked[:start] + put + masked[end:]
        assert masked == token_counts._LONG_NUMBER.sub("<number>", t)
    pre, rnd = token_counts.PreTokens(P.path("byte_bpe_50k.tiktoken"), P.PATTERN), random.Random(9)
    letters, some = " \n\tab'slDr1é!<", list(texts.values())
    for k in range(600):
        tree = token_counts.CountTree("".join(rnd.choice(letters) for _ in range(rnd.randint(0, 300))) if k % 2 else some[k % len(some)][:400], pre)
        for _ in range(4):
            a = rnd.randint(0, len(tree.text))
            b = min(len(tree.text), a + rnd.choice([0, 1, 3, 40]))
            put = "".join(rnd.choice(letters) for _ in range(rnd.choice([0, 0, 1, 5])))
            want = tree.text[:a] + put + tree.text[b:]
            tree.edit(a, b, put)
            assert tree.text == want and tree.total == n(want)
    tree = token_counts.CountTree("word " * 5000, pre)
    tree.edit(12_000, 12_002, "xy")
    assert tree.reencoded < 8
    assert len(token_counts.count_tokens(table(spark, ODD), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, token_counts.revise).collect()) == len(ODD) + 3
    assert token_counts.count_tokens(table(spark, ODD).limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_edits_of_long_texts():
    """Thousands of edits of a long text, long insertions and long runs among them: counts as anew, leaves bounded, time linear."""
    import time

    import public_tokenizers as P

    pre, rnd = token_counts.PreTokens(P.path("byte_bpe_50k.tiktoken"), P.PATTERN), random.Random(13)
    fresh = lambda t: sum(pre.counts(pre.cut(t)))
    text = "".join(rnd.choice(["word ", "  ", "\n", "it's ", "12345", "é" * 40, " " * 70, "x" * 300]) for _ in range(6000))
    tree = token_counts.CountTree(text, pre)
    for k in range(400):
        a = rnd.randint(0, len(text))
        b = min(len(text), a + rnd.choice([0, 2, 30, 3000]))
        put = rnd.choice(["", " ", "ab", "new words " * 150, " " * 50])
        text = text[:a] + put + text[b:]
        tree.edit(a, b, put)
        if k % 20 == 0:
            assert tree.text == text and tree.total == fresh(text) and max(map(len, tree.lengths)) <= 4 * token_counts.LEAF
    assert tree.text == text and tree.total == fresh(text)

    def took(n):
        t = token_counts.CountTree("some words here " * n, pre)
        began = time.process_time()
        for i in range(n):
            t.edit(16 * i, 16 * i + 4, "four")
        return time.process_time() - began

    took(500)
    assert took(16_000) < 16 * took(2000)


# ---- 10 --------------------------------------------------------------------------------------------------------------


def test_leaks_contained(spark, sf_dir, texts):
    bench = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in queries.op10_decontamination(spark, sf_dir).collect()}
    assert {(i, k) for i, t in texts.items() for k, x in bench.items() if x in t} <= got


def brute_leaks(texts, items):
    """Similarity of every text and item at their best window: all windows of all sizes, trimmed, with weights over all items."""
    w = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
    sh = lambda x: [tuple(x[i : i + 5]) for i in range(len(x) - 4)]
    all_items = [(k, sh(w(x))) for k, x in items]
    all_items = [(k, x) for k, x in all_items if x]
    held = Counter(g for _, x in all_items for g in set(x))
    weigh = lambda g: max(1, round(1000 * math.log1p(len(all_items) / held.get(g, 1))))
    total = lambda c: sum(weigh(g) * n for g, n in c.items())
    out = {}
    for i, t in texts:
        own = sh(w(t))
        for k, item in all_items:
            have = Counter(item)
            for size in {min(len(own), -(-len(item) * tenths // 10)) for tenths in (10, 9, 8)}:
                for s in range(len(own) - size + 1 if own else 0):
                    win = own[s : s + size]
                    at = [j for j, g in enumerate(win) if g in have]
                    if at:
                        both = total(Counter(win[at[0] : at[-1] + 1]) & have)
                        alike = both / (total(Counter(win[at[0] : at[-1] + 1])) + total(have) - both)
                        out[i, k] = max(alike, out.get((i, k), 0))
    return {x: v for x, v in out.items() if v >= 0.8 - 1e-12}


def _planted(seed, n_texts=60, sizes=(8, 70)):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 7)))
    shared = " ".join(word() for _ in range(12))  # a passage of many items, so that weights differ
    items = {k: " ".join(word() for _ in range(rnd.randint(*sizes))) + (" " + shared if k % 3 == 0 else "") for k in range(30)} | {30: "too short", 31: None, 32: "la " * 20}
    texts = {}
    for i in range(n_texts):
        body = [word() for _ in range(rnd.randint(0, 80))]
        own = items[rnd.randrange(30)].split()
        for _ in range(rnd.choice([0, 0, 1, 1, 2])):
            own[rnd.randrange(len(own))] = word()
        own = own[: len(own) - rnd.choice([0, 0, 0, len(own) // 12, len(own) // 7])]
        if i % 3:
            body[rnd.randint(0, len(body)) : 0] = own if i % 2 else ", ".join(own).upper().split()
        texts[i] = " ".join(body) if i != 4 else "oh la " + "la " * 19
    return texts, items


def test_leaks_against_all_windows(spark):
    texts, items = _planted(10)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    found = decontamination.find_leaks(df, bench).collect()
    got, want = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in found}, {k: round(v, 9) for k, v in brute_leaks(texts.items(), items.items()).items()}
    assert got == want and len(want) > 20 and any(v < 1 for v in want.values()) and all(r.n_bits <= decontamination.RADIUS for r in found)
    kept = {r.doc_id for r in decontamination.without_leaks(df, bench).collect()}
    assert kept == set(texts) - {i for i, _ in want}


def test_leaks_dont_depend_on_blocks_of_items(spark):
    """Whether items come in blocks of four or all at once, and in whatever partitions, rows are the same."""
    texts, items = _planted(11, 24)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    rows = lambda b, **more: sorted(tuple(r) for r in decontamination.find_leaks(df, b, **more).collect())
    want = rows(bench)
    assert want and rows(bench, size=8) == want and rows(bench.repartition(3).sortWithinPartitions(F.desc("item_id")), size=12) == want
    assert {r.doc_id for r in decontamination.without_leaks(df, bench, size=12).collect()} == {i for i in texts if i not in {x[0] for x in want}}


@pytest.mark.parametrize("n", [5, 6, 8, 12, 20, 37, 60, 120])
def test_recall_by_item_length(n):
    """Items of n words, copies with as many changes as leave a similarity of 0.8 or a little more: what the index misses of them."""
    rnd = random.Random(n)
    word = lambda: "".join(rnd.choice("abcdefghijklm") for _ in range(6))
    texts, items = [], []
    for k in range(150):
        item = [word() for _ in range(n)]
        own, cut = list(item), rnd.randrange(3)
        if cut == 0:  # cut short as far as the similarity allows
            own = own[: 4 + -(-(n - 4) * 4 // 5)]
        elif n >= 49:
            own[rnd.randrange(5, n - 5)] = word()
        elif n >= 12:
            own[0] = word()
        texts.append((k, " ".join([word() for _ in range(rnd.randint(0, 6))] + own + [word() for _ in range(rnd.randint(0, 6))])))
        items.append((k, " ".join(item)))
    got = decontamination.Shingled([x for _, x in items], 5)
    bench = decontamination.Benchmark([(k, got.of_text(k), np.ones(len(got.of_text(k)), np.int64)) for k, _ in items], len(items))
    found = {(t, i) for t, i, *_ in bench.matches([x for _, x in texts])}
    mine = {(k, k) for k in range(150) if brute_leaks([texts[k]], [items[k]])}
    assert len(mine) > 100 and len(found & mine) >= 0.99 * len(mine)


@pytest.mark.parametrize("n", [300, 3000])
def test_hamming_blocks_guarantee(n):
    """Few fingerprints (looked through) and many (looked up): all pairs within the radius, and no others; few candidates."""
    rng = np.random.default_rng(11)
    prints = rng.integers(0, 1 << 63, (n, 4), dtype=np.uint64)
    index = decontamination.HammingBlocks(prints)
    near = prints[:120].copy()
    for k in range(120):
        for b in rng.choice(256, k, replace=False):
            near[k, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    asked = np.vstack((prints[:20], near, rng.integers(0, 1 << 63, (40, 4), dtype=np.uint64)))
    got = set(zip(*(x.tolist() for x in index.find(asked)), strict=True))
    far = np.bitwise_count(asked[:, None, :] ^ prints[None, :, :]).sum(axis=2)
    assert got == set(zip(*(x.tolist() for x in np.nonzero(far <= decontamination.RADIUS)), strict=True)) and len(got) >= 84
    assert len(index._candidates(np.ascontiguousarray(asked).view("<u2"))) < 0.25 * far.size


def test_leak_edges(spark):
    df = table(spark, ODD)
    none = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "word " * 12), (1, "word " * 12), (None, "null id text here and more")], "item_id long, text string")
    assert decontamination.find_leaks(df, none).count() == 0 and decontamination.without_leaks(df, none).count() == df.count()
    assert {r.doc_id for r in decontamination.find_leaks(df, one).collect()} == {5}
    twice = spark.createDataFrame([(1, "x y alpha beta gamma delta epsilon zeta, alpha beta gamma delta epsilon zeta"), (2, None)], "doc_id long, text string")
    item = spark.createDataFrame([(7, "Alpha beta gamma delta epsilon zeta!")], "item_id long, text string")
    assert [(r.first_word, r.n_words, r.similarity) for r in decontamination.find_leaks(twice, item).collect()] == [(2, 6, 1.0)]
    assert decontamination.without_leaks(df, one).columns == df.columns and decontamination.find_leaks(df.limit(0), one).count() == 0


def test_long_words_of_marks_take_time_in_proportion():
    """Words of 200,000 characters, within a second each; the rule is that of the expression it stands for."""
    import time

    rule = re.compile(r"(?:[#*$%&<>|~^=_!?]{2,})[.,;:]?$")
    rnd = random.Random(7)
    for _ in range(3000):
        w = "".join(rnd.choice("a#*!?.,;:(") for _ in range(rnd.randint(1, 6)))
        assert line_quality.is_decorated(w) == bool(rule.search(w)), w
    for make in (lambda n: "#" * n + "(", lambda n: "#" * n + ".", lambda n: "!." * (n // 2) + "(", lambda n: "." + ")" * n + "x", lambda n: ".\"" * (n // 2) + "x", lambda n: "|" * n):
        began = time.time()
        line_quality.line_fault(make(200_000))
        assert time.time() - began < 1
