"""The operators on small fixtures against brute force, with the cases that break things.

Nulls in every column, empty and very long texts, ties, repeated rows, empty tables and
extra columns whose names clash with the operators' own.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tersely.llm import (
    bpe,
    chat,
    decontaminate,
    near_copies,
    pii,
    quality,
    substrings,
    token_files,
    top_k,
    url_rules,
)
from tersely.llm.common import text_key
from tersely.llm.components import components

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
LOWER = {i: i + 32 for i in range(65, 91)}
DOCS = "doc_id long, text string, lang string, row string, n_words int, hits int, key int, kept int"


def made_docs(spark, rows):
    """Documents with extra columns named like the operators' own."""
    return spark.createDataFrame([(i, t, "en", "x", 1, 2, 3, 4) for i, t in rows], DOCS)


def counted(rows):
    return sorted((tuple(r) for r in rows), key=str)


# URL filters


def test_urls_nested_rules_and_odd_rows(spark):
    rules = [
        ("allow", "org", "/"), ("block", "a.org", "/x/"), ("allow", "a.org", "/x/y/"),
        ("block", "a.org", "/x/y/z"), ("block", "B.a.org", ""), ("allow", "a.org", "/x/"),
        (None, None, "/"),
    ]
    urls = [
        "http://a.org/x/y/z?q", "https://s.a.org/x/y/", "http://A.ORG/x/yy", "http://b.a.org", "http://a.org",
        "http://xa.org/x/", "org/x/", "://", "", None, "http://a.org/X/", "ftp://b.a.org#/x", "http://a.org./x/",
        "x://y://a.org/", *["http://a.org/x/y/z"] * 40,
    ]
    pages = spark.createDataFrame(
        [(n % 3 or None, u, "old", "rule", 7) for n, u in enumerate(urls)],
        "page_id long, url string, host string, rule string, row_id int",
    )
    known = [(v, (h or "").translate(LOWER), p) for v, h, p in rules if h]

    def judge(url):
        if url is None or "://" not in url:
            return "", "", None, "allow"
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = host.translate(LOWER)
        fit = [
            (len(h + p), len(h), h + p, v)
            for v, h, p in known
            if (host == h or host.endswith("." + h)) and path.startswith(p)
        ]
        return (host, path, *max(fit)[2:]) if fit else (host, path, None, "allow")

    table = spark.createDataFrame(rules, url_rules.RULES)
    got = url_rules.judge_urls(pages, table).select("page_id", "row_id", "url", "host", "path", "rule", "verdict")
    expected = [(n % 3 or None, 7, u, *judge(u)) for n, u in enumerate(urls)]
    assert counted(got.collect()) == counted(expected)
    none = spark.createDataFrame([], url_rules.RULES)
    verdicts = url_rules.judge_urls(pages, none, default="block").select("verdict").distinct().collect()
    assert [r.verdict for r in verdicts] == ["block"]
    assert url_rules.judge_urls(pages.limit(0), table).count() == 0


# benchmark decontamination


def index_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_contamination(docs, items, window=13):
    windows = {}
    for item, text in items:
        w = index_words(text)
        for k in range(max(1, len(w) - window + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + window]), set()).add(item)
    for doc, text in docs:
        w, hit, found = index_words(text), set(), set()
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                own = windows.get(tuple(w[k : k + size]))
                if own:
                    hit |= set(range(k, k + size))
                    found |= own
        names = sorted(str(i) for i in found if i is not None)
        yield doc, len(w), len(hit), names, bool(hit) and 20 * len(hit) >= len(w)


def test_contamination(spark):
    pick = random.Random(4)
    base = [[pick.choice("a b c d e É f3".split()) for _ in range(n)] for n in (30, 13, 12, 5, 1, 20)]
    items = [(n, " ".join(w).upper() if n == 1 else ", ".join(w)) for n, w in enumerate(base)]
    items += [(7, None), (8, ""), (9, "..."), (None, "the null item"), (0, items[0][1]), (2, "zz yy")]
    docs = [(1, None), (2, ""), (3, " -- "), (None, "The null item!"), (None, None), (4, "x " * 400 + items[0][1])]
    for n in range(10, 40):
        words = [pick.choice("a b c d e é f3".split()) for _ in range(pick.randrange(40))]
        cut = pick.choice(base)
        at = pick.randrange(len(words) + 1)
        docs.append((n, "." * (n % 3) + " ".join(words[:at] + cut + words[at:]) + "!" * (n % 2)))
    docs += [docs[-1], (39, "other text of one id"), (50, "a b c " * 20_000)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.judged(decontaminate.contamination(made_docs(spark, docs), bench))
    got = found.select("doc_id", "n_words", "n_hit", "items", "contaminated").collect()
    assert counted(got) == counted(brute_contamination(docs, items))
    for few in (made_docs(spark, docs[:3]), made_docs(spark, [])):
        clean = decontaminate.judged(decontaminate.contamination(few, bench.limit(0))).collect()
        assert len(clean) == few.count() and not any(r.contaminated for r in clean)


def test_proximity(spark):
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    docs = made_docs(spark, [(1, "zero one two 3 four five six"), (2, "one of six"), (3, None)])
    got = decontaminate.proximity(docs, bench, least=0.8).collect()
    assert [(r.doc_id, r.item_id, r.start, round(r.share, 3)) for r in got] == [(1, 1, 1, 0.833)]


# substring dedup


def brute_substrings(docs, window):
    seen, out = {}, []
    order = sorted(set(docs), key=lambda d: (d[0] is not None, d[0] or 0, d[2]))
    covered = {}
    for doc, text, key in order:
        words = re.findall("[^ \t-\r]+", text or "")
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            run = tuple(words[k : k + window])
            if run in seen:
                gone[k : k + window] = [True] * window
            seen.setdefault(run, True)
        covered[doc, text, key] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g))
    for row in docs:
        out.append((row[0], *covered[row]))
    return out


def test_substrings(spark):
    pick = random.Random(2)
    words = [f"w{n}" for n in range(400)]
    passage = [pick.choice(words) for _ in range(55)]
    rows = [(None, None), (None, " ".join(passage)), (1, ""), (2, " \t\n "), (3, "a " * 30_000), (4, "a " * 45), (5, "b")]
    for n in range(10, 40):
        own = [pick.choice(words) for _ in range(pick.randrange(80))]
        cut = passage[pick.randrange(20) : pick.randrange(30, 56)]
        at = pick.randrange(len(own) + 1)
        rows.append((n, "\n".join(own[:at] + cut + own[at:] + cut * (n % 2))))
    rows += [rows[-1], rows[-1], (39, rows[-2][1] + " more"), (80, rows[9][1]), (81, " ".join(passage[:20]))]
    docs = made_docs(spark, rows)
    keys = {r.text: r.key for r in docs.select("text", F.shiftrightunsigned(F.xxhash64("text"), 32).alias("key")).collect()}
    expected = brute_substrings([(i, t, keys[t]) for i, t in rows], 20)
    got = substrings.remove_repeats(docs.repartition(5)).collect()
    assert counted([tuple(r)[:4] for r in got]) == counted(expected)
    assert substrings.remove_repeats(docs.limit(0)).count() == 0
    split = lambda text: re.findall("[^ \t-\r]+", text or "")
    texts = {}
    for doc, text in rows:
        texts.setdefault(doc, []).append(split(text))
    order = lambda doc: (doc is not None, doc or 0)
    for row in got:
        covered = set()
        for f in row.factors:
            assert f.length >= 20 and order(f.source) <= order(row.doc_id)
            copies = [
                (own[f.start : f.start + f.length], source[f.source_start : f.source_start + f.length])
                for own in texts[row.doc_id] for source in texts[f.source]
                if len(own) == row.n_words
            ]
            assert any(a == b and len(a) == f.length for a, b in copies)
            assert f.source != row.doc_id or f.source_start != f.start or len(texts[row.doc_id]) > 1
            covered |= set(range(f.start, f.start + f.length))
        assert len(covered) == row.n_removed


def test_greedy_factors_equal_a_brute_force_parse():
    """From the first place of each run as far as both sides agree; sources may overlap the factor."""
    pick = np.random.default_rng(4)
    for letters in (2, 3, 9):
        for _ in range(150):
            body = pick.integers(0, letters, pick.integers(1, 60))
            stretch = np.cumsum(pick.random(len(body)) < 0.2)
            leader = np.array([int(np.flatnonzero(body == run)[0]) for run in body])
            known = leader < np.arange(len(body))
            expected, at = [], 0
            while at < len(body):
                size = 0
                if known[at]:
                    source = int(leader[at])
                    while (
                        at + size < len(body) and known[at + size]
                        and stretch[at + size] == stretch[at] and stretch[source + size] == stretch[source]
                        and body[source + size] == body[at + size]
                    ):
                        size += 1
                    expected.append((at, size, source))
                at += max(size, 1)
            found = zip(*(x.tolist() for x in substrings.greedy(body, leader, known, stretch)))
            assert sorted(found) == expected


def test_very_long_segments_are_cut(monkeypatch):
    monkeypatch.setattr(substrings, "MOST", 7)
    text = " ".join(str(n) for n in range(200))
    ids, keys = np.array([1, 2]), np.array([5, 6], np.uint32)
    blobs = [row[2] for row in substrings.segments(ids[:1], keys[:1], [text], 20, 1)]
    blobs += [row[2] for row in substrings.segments(ids[1:], keys[1:], [text], 20, 1)]
    spans = substrings.parsed(blobs)
    assert set(spans["doc"]) == {2} and spans["n"].sum() == 181


# top-k


def test_top_k(spark):
    pick = np.random.default_rng(1)
    rows = [(n, [float(x) for x in pick.normal(size=24)]) for n in range(1, 90)]
    rows += [(n, rows[4][1]) for n in range(100, 140)]  # ties
    rows += [(160, None), (161, []), (162, [None] * 24), (163, [float("nan")] * 24), (164, [float("inf")] + [0.0] * 23)]
    rows += [(None, rows[0][1]), (200, rows[3][1][:10]), (200, rows[3][1][:10]), (220, [1e6] * 24), (7, rows[6][1])]
    df = spark.createDataFrame(
        [(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, score int, rank double"
    )
    good = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    ints = [(i, [int(np.floor(64 * x)) for x in v] + [0] * (24 - len(v))) for i, v in good]
    expected = []
    for query, q in {(i, tuple(v)) for i, v in ints if i % 20 == 0}:
        found = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), i) for i, v in ints if i != query)[:20]
        expected += [(query, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    got = top_k.top_k(df.repartition(3), F.col("vec_id") % 20 == 0).collect()
    assert counted(got) == counted(expected)
    assert top_k.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_of_many_blocks(spark, monkeypatch):
    """Blocks and groups of blocks of few vectors, all equal ones and empty ones among them."""
    for name, size in (("CANDIDATES", 7), ("QUERIES", 3), ("HELD", 2)):
        monkeypatch.setattr(top_k, name, size)
    pick = np.random.default_rng(3)
    rows = [(n, [float(x) for x in pick.normal(size=40)]) for n in range(80)]
    rows += [(n, [1.0] * 40) for n in range(80, 120)] + [(n, []) for n in range(120, 130)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    ints = [(i, [int(np.floor(64 * x)) for x in v] + [0] * (40 - len(v))) for i, v in rows]
    expected = []
    for query, q in ((i, v) for i, v in ints if i % 10 == 0):
        found = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), i) for i, v in ints if i != query)[:5]
        expected += [(query, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    assert counted(top_k.top_k(df, F.col("vec_id") % 10 == 0, k=5).collect()) == counted(expected)


def test_top_k_of_huge_components(spark):
    """Exact as long as scores fit 64 bits, else an error that names the ids."""
    schema = "vec_id long, embedding array<double>"
    fits = spark.createDataFrame([(0, [2.0**30, 1.0]), (1, [2.0**20 + 1, 3.0]), (3, [-(2.0**20), 0.5])], schema)
    got = top_k.top_k(fits, F.col("vec_id") == 0, k=2).collect()
    assert [(r.vec_id, r.score) for r in got] == [
        (1, 2**36 * 64 * (2**20 + 1) + 64 * 192), (3, -(2**36) * 2**26 + 64 * 32)
    ]
    for huge in (1e19, 1e300, 1e307):
        broken = spark.createDataFrame([(20, [huge, 1.0]), (41, [huge, 2.0])], schema)
        with pytest.raises(Exception, match="20|41"):
            top_k.top_k(broken, F.col("vec_id") == 20).collect()


def test_top_k_beyond_floating_point():
    ids = np.arange(4)
    columns = np.array([[2.0**30, 2.0**30, 2.0**30 + 1, 3.0]])
    (_, scores), *_ = top_k.search(ids[:1], columns[:, :1], ids, columns, 2)
    assert [int(s) for s in scores] == [2**30 * (2**30 + 1), 2**60]


# token files


TEXTS = [
    None, "", " ", "  two  spaces \n\n lines\t\n", "don't we'll I'S 'tis", "<|endoftext|> and <|startoftext|>x",
    "É è«»…“q”’s", "\x1c\x1d\x85 \u2003x", "日本語, ٣٤ ²³ a1b2", "%%%&&& a,b.c!d-e_f", "x" * 70_000, "aaaa aaa " * 3000,
    "İıſẞΣΑΣ", "e\u0301 A\u030a", "\U0001f600\u200d\U0001f468", "a\x00b\x7f",
]


def test_token_files(spark, tmp_path):
    rows = [(n, t) for n, t in enumerate(TEXTS)] + [(None, "null id"), (3, "again"), (3, "again")]
    docs = made_docs(spark, rows)
    places = token_files.token_places(spark, docs, BYTES, 2, f"file://{tmp_path}/ids")
    library = Tokenizer.from_file(BYTES)
    expected, start = [], 0
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    for doc, text in order:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        expected.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert counted(places.collect()) == counted(expected)
    whole = b"".join(
        (tmp_path / "ids" / f"part-{r.part}.bin").read_bytes()
        for r in sorted(token_files.write_token_files(docs, f"file://{tmp_path}/ids", BYTES, 2).collect())
    )
    assert len(whole) == 2 * start
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with parts of some size
    try:
        manifest = token_files.write_token_files(docs, f"file://{tmp_path}/many", BYTES, 2)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    parts = manifest.count()
    reader = token_files.read_token_files(manifest, f"file://{tmp_path}/many", 2)
    tasks = {r.task for r in reader.select(F.spark_partition_id().alias("task")).distinct().collect()}
    assert parts > 1 and len(tasks) == parts  # a task for each part
    assert token_files.token_places(spark, docs.limit(0), BYTES, 2, f"file://{tmp_path}/none").count() == 0


# BPE


def test_bpe_equals_library():
    own, library = bpe.PairIndexBpe(WORDS), Tokenizer.from_file(WORDS)
    texts = [t or "" for t in TEXTS]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert own.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False)


def test_bpe_lower_rank_in_the_middle(tmp_path):
    """A merge whose result has a pair of lower rank must wait for it."""
    import json

    said = json.load(open(WORDS))
    letters = ["a", "b", "a</w>", "b</w>", "aa", "aab", "aab</w>", "aa</w>"]
    merges = [["aa", "b</w>"], ["aa", "b"], ["aa", "a"], ["a", "a"], ["a", "a</w>"], ["aaa", "a"]]
    letters += ["aaa", "aaaa"]
    said["model"] |= {"vocab": {t: n for n, t in enumerate(letters)}, "merges": merges}
    said["added_tokens"] = []
    path = tmp_path / "small.json"
    path.write_text(json.dumps(said))
    own, library = bpe.PairIndexBpe(str(path)), Tokenizer.from_file(str(path))
    texts = ["".join(random.Random(n).choice("aaab") for _ in range(1 + n % 19)) for n in range(300)]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_bpe_documents(spark):
    rows = [(n, t) for n, t in enumerate(TEXTS)] + [(None, "null id"), (3, "again"), (3, "again")]
    library = Tokenizer.from_file(WORDS)
    expected = []
    for doc, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        sha = [hashlib.sha256(x).hexdigest() for x in (np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False).encode())]
        expected.append((doc, len(ids), *sha))
    docs = made_docs(spark, rows)
    assert counted(bpe.bpe_digests(docs, WORDS).collect()) == counted(expected)
    assert bpe.bpe_digests(docs.limit(0), WORDS).count() == 0
    full = bpe.encode_documents(docs, WORDS).where("doc_id = 4").first()
    assert full.token_ids == library.encode(TEXTS[4], add_special_tokens=False).ids


# chat


def test_chat(spark):
    rows = [(1, 0, "ann", "hi"), (1, 1, "bob", "é\nyo"), (1, 1, "bob", "é\nyo"), (1, 300, "ann", None), (1, None, None, "x"),
            (None, 0, "ann", "lone"), (2, 5, "", "")]
    table = spark.createDataFrame(
        [(*r, "clash", 1) for r in rows], "conv_id long, turn int, role string, text string, block string, at int"
    )
    blocks = {}
    for conv, turn, role, text in rows:
        own = blocks.setdefault((conv, None if turn is None else turn // 256), [])
        own.append((turn is not None, turn or 0, "unknown" if role is None else role, text or ""))
    expected = []
    for (conv, block), turns in blocks.items():
        speakers = {t[2] for (c, _), ts in blocks.items() if c == conv for t in ts}
        for speaker in speakers:
            out, mask = "", []
            for *_, role, text in sorted(turns):
                out += "<|assistant|>\n" if role == speaker else f"<|user|> {role}\n"
                start = len(out)
                out += text + "<|end|>\n"
                mask += [(start, len(out))] * (role == speaker)
            expected.append((conv, block, speaker, len(turns), out, mask))
    got = [(*r[:5], [tuple(m) for m in r.mask]) for r in chat.perspectives(table).collect()]
    assert counted(got) == counted(expected)
    assert chat.perspectives(table.limit(0)).count() == 0


# personal data


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_base(text):
    for kind, pattern in PATTERNS.items():
        for match in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", match[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(re.fullmatch("0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])", p) for p in match[0].split(".")),
                "card": 13 <= len(digits) <= 19
                and sum(sum(divmod(2 * int(d), 10)) if n % 2 else int(d) for n, d in enumerate(digits[::-1])) % 10 == 0,
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                yield kind, *match.span()


def test_pii_base_kinds():
    pick = random.Random(3)
    bits = ["a", "Z", "9", "12", "255", "256", "007", "@", "@b.c", ".", ".", "-", " ", "+", "+1", "(", ")", "é", "_%",
            "4111111111111111", "://", "\n", "4111-1111 1111 1111", "٣", "1.2.3.4"]
    texts = ["".join(pick.choice(bits) for _ in range(pick.randrange(40))) for _ in range(4000)]
    texts += ["1." * 9000, "9" * 20_000, "+1" * 5000 + "(" * 20_000, "a@" * 9000, "@" * 20_000, "0" * 5000 + ".0.0.1"]
    for text in texts:
        base = [s for s in pii.find_spans(text) if s[0] in pii.BASE_KINDS]
        assert base == list(brute_base(text)), text[:200]


def test_pii_added_kinds_and_masking():
    text = "ftp://ann:pw@h.org/x IBAN: DE89 3704 0044 0532 0130 00. IBAN DE00370400440532013000 mailto:a@b.org tel:123"
    found = [(kind, text[s:e]) for kind, s, e in pii.find_spans(text) if kind not in pii.BASE_KINDS]
    assert found == [("login", "ann:pw"), ("account", "DE89 3704 0044 0532 0130 00"), ("address", "123")]
    account = "DE89 3704 0044 0532 0130 00"
    for before, after in (
        ("IBAN ", " BIC COBADEFFXXX"), ("Iban: ", ""), ("ACCOUNT ", " EUR"), ("IBAN number ", "."),
        ("Account No. ", "\nX"), ("my account is ", " AB12"), ("iban:", " " + "A1 " * 40),
    ):
        for sign in (account, account.replace(" ", "")):
            text = before + sign + after
            assert [text[s:e] for kind, s, e in pii.find_spans(text) if kind == "account"] == [sign], text
    for text in ("IBAN DE88370400440532013000", "IBAN " + "A" * 90_000, "account of DE89370400440532013000X", "IBAN DE89"):
        assert not [s for s in pii.find_spans(text) if s[0] == "account"], text[:60]
    assert pii.masked("x a@b.c, +1 (234) 555-6789.", pii.find_spans("x a@b.c, +1 (234) 555-6789.")) == "x [email], [phone]."


def test_pii_documents(spark):
    rows = [(1, "a@b.c 1.2.3.4"), (1, "a@b.c 1.2.3.4"), (None, "x +123456789"), (2, None), (3, ""), (4, "x" * 100_000 + " q@r.s")]
    docs = made_docs(spark, rows)
    for row in pii.pii_spans(docs).collect():
        text = next(t for i, t in rows if i == row.doc_id) or ""
        found = list(brute_base(text))
        kinds = [kind for kind, *_ in found]
        assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == tuple(map(kinds.count, pii.BASE_KINDS))
        assert row.spans == pii.listed(pii.find_spans(text))
        base = ",".join(f"{k}:{s}:{e}" for k, s, e in found)
        assert row.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert pii.pii_spans(docs.limit(0)).count() == 0
    masked = pii.mask_pii(docs)
    assert masked.schema == docs.schema
    texts = {(r.doc_id, r.text and r.text[-20:]) for r in masked.collect()}
    assert texts == {(1, "[email] [ip]"), (None, "x [phone]"), (2, None), (3, ""), (4, "x" * 12 + " [email]")}


# near copies


def brute_near(rows, size, percent):
    sets = []
    for _, text in rows:
        w = re.findall("[^ \t-\r]+", (text or "").translate(LOWER))
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    group = list(range(len(rows)))

    def top(n):
        while group[n] != n:
            n = group[n]
        return n

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            same_id = rows[x][0] is not None and rows[x][0] == rows[y][0] and sets[x] and sets[y]
            if both and 100 * both >= percent * len(sets[x] | sets[y]) or same_id:
                group[top(x)] = top(y)
    for n, (doc, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if top(m) == top(n) and rows[m][0] is not None]
        component = min(ids) if ids else None
        yield doc, len(sets[n]), component, component is None or doc == component


def test_near_copies(spark):
    pick = random.Random(5)
    words = [f"v{n}" for n in range(300)]
    base = [[pick.choice(words) for _ in range(90)] for _ in range(4)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one TWO"), (6, "one"), (7, "x " * 20_000)]
    for n in range(20, 90):  # chains of small changes, so links of links count
        text = list(base[n % 4])
        for _ in range(pick.randrange(3)):
            text[pick.randrange(90)] = pick.choice(words)
        if n % 5 == 0:
            base[n % 4] = text
        rows.append((n, " ".join(text)))
    rows += [rows[-1], rows[-2], (200, rows[-1][1]), (None, rows[-1][1]), (None, "no id here at all"), (None, None)]
    docs = made_docs(spark, rows)
    for size, percent in ((4, 80), (5, 80)):
        got = near_copies.near_copies(docs, shingle=size, percent=percent).drop("doc_key").collect()
        assert counted(got) == counted(brute_near(rows, size, percent))
    assert near_copies.near_copies(docs.limit(0)).count() == 0


def test_near_copies_without_ids(spark):
    """Near copies are linked whether or not their rows have ids; one of each group stays."""
    words = [f"w{n}" for n in range(60)]
    near = [" ".join([*words[:k], "other", *words[k + 1 :]]) for k in (5, 25, 45)]
    apart = " ".join(f"z{n}" for n in range(40))
    rows = [(None, text) for text in [*near, near[0], apart]] + [(7, " ".join(words[30:] * 2)), (None, " ".join(words[30:] * 2))]
    got = near_copies.near_copies(made_docs(spark, rows), shingle=3, percent=80)
    kept = {row.doc_key for row in got.where("kept").collect()}
    found = {row.text: row.key for row in made_docs(spark, rows).select("text", text_key().alias("key")).collect()}
    assert len(kept & {found[t] for t in near}) == 1 and found[apart] in kept
    named = [(r.doc_id, r.component_id, r.kept) for r in got.where(F.col("doc_key") == found[rows[-1][1]]).collect()]
    assert sorted(named, key=str) == [(7, 7, True), (None, 7, False)]
    again = near_copies.near_copies(made_docs(spark, [(100 + n, t) for n, t in enumerate(near)] + rows), shingle=3, percent=80)
    least = {row.component_id for row in again.collect() if row.doc_key in {found[t] for t in near}}
    assert least == {100}


def test_components_of_a_long_chain(spark):
    links = [(n, n + 1) for n in range(100, 160)] + [(5, 9), (9, 7), (9, 9)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: 100 for n in range(100, 161)} | {5: 5, 7: 5, 9: 5}


# quality


def brute_bits(trained, text):
    """Bits of a text under interpolated modified Kneser-Ney, straight from its definition."""
    from collections import Counter

    order, begin, end = quality.ORDER, quality.BEGIN, quality.END
    pad = lambda t: begin * (order - 1) + re.sub("[0-9]", "0", t) + end
    counts = {order: Counter()}
    for t in trained:
        p = pad(t)
        counts[order].update(p[k : k + order] for k in range(len(p) - order + 1))
    for size in range(order - 1, 0, -1):
        counts[size] = Counter(g[1:] for g in counts[size + 1])
    less = {}
    for size, own in counts.items():
        n = Counter(own.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        less[size] = [0.0] + [max(0.0, k - (k + 1) * y * n[k + 1] / n[k]) if n[k] else 0.5 for k in (1, 2, 3)]

    def chance(gram):
        size = len(gram)
        if not size:
            return 1 / (len(counts[1]) + 1)
        around = [c for g, c in counts[size].items() if g[:-1] == gram[:-1]]
        if not around:
            return chance(gram[1:])
        c = counts[size][gram]
        rest = sum(less[size][min(c, 3)] for c in around) / sum(around)
        share = max(0.0, c - less[size][min(c, 3)]) / sum(around) if c else 0.0
        return share + rest * chance(gram[1:])

    p = pad(text)
    return -sum(np.log2(chance(p[k : k + order])) for k in range(len(p) - order + 1))


@pytest.fixture
def quality_tables(spark, tmp_path):
    pick = random.Random(6)
    good = lambda: " ".join(pick.choice("the cat sat on a mat and ran 12 far".split()) for _ in range(30))
    rows = [(n, good(), "en") for n in range(40)] + [(100, good(), "en"), (101, "%$# QQ zz!! " * 12, "en")]
    rows += [(102, None, "en"), (103, "", "en"), (104, "mot", "fr"), (105, good(), None), (106, good(), "en"), (106, good(), "en")]
    rows += [(None, good(), "en"), (107, "sa lu", "fr"), (0, rows[0][1], "en")]
    docs = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, lang string, kept int, score double")
    docs.write.parquet(str(tmp_path / "docs"))
    marks = [(n, 1, 0) for n in range(40)] + [(101, 0, 0), (107, 1, None), (5, 0, 0), (None, 1, 0), (3, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    return rows, marks, spark.read.parquet(str(tmp_path / "docs")), labels


def test_quality(spark, quality_tables):
    rows, marks, docs, labels = quality_tables
    got = quality.quality(docs, labels).collect()
    assert len(got) == len(rows)
    by_id = {}
    for row in got:
        by_id.setdefault(row.doc_id, []).append(row)
    assert by_id[100][0].kept and by_id[None][0].kept and all(r.kept for r in by_id[106])
    assert not by_id[101][0].kept and not by_id[102][0].kept and not by_id[103][0].kept
    assert by_id[105][0].kept and by_id[105][0].score is None  # no model for its language

    bad = {i for i, q, t in marks if q != 1 or t == 1}
    trusted = {i for i, *_ in marks} - bad - {None, 101}
    keys = docs.select("doc_id", "text", F.xxhash64("text").alias("key")).where("lang = 'en'").distinct().collect()
    order = sorted((r.key, r.doc_id, r.text) for r in keys if r.doc_id in trusted)
    trained = order[: (len(order) + 1) // 2]
    texts = [t for _, _, t in trained]
    texts += [r[1] for r in rows if r[0] == 0 and r[1] in texts][1:]  # the repeated row
    known = [(r[0], brute_bits(texts, r[1]), len(r[1]) + 1) for r in rows if r[0] in trusted and r[2] == "en"]
    mean = sum(b for _, b, _ in known) / sum(n for _, _, n in known)
    for doc, bits, n in known:
        expected = (bits + quality.PRIOR * mean) / (n + quality.PRIOR)
        assert by_id[doc][0].score == pytest.approx(expected, rel=1e-9)


def test_quality_of_empty_tables(spark, quality_tables):
    _, _, docs, labels = quality_tables
    assert quality.quality(docs.limit(0), labels).count() == 0
    free = quality.quality(docs, labels.limit(0)).collect()
    assert all(r.kept == (r.n_chars > 0) for r in free)


def test_probabilities_are_found_without_the_partition_files(spark, quality_tables, monkeypatch):
    _, _, docs, labels = quality_tables
    want = counted(quality.quality(docs, labels).collect())
    real = quality.Probabilities.__init__

    def lost(self, folder, part):
        real(self, folder, part + 10_000)

    monkeypatch.setattr(quality.Probabilities, "__init__", lost)
    assert counted(quality.quality(docs, labels).collect()) == want


def test_five_characters_packed_by_shard(spark, tmp_path):
    assert quality.ORDER == 5
    texts = ["na\u00efve \U0001f600 caf\u00e9 12", "a\U0001f600b\U0001f600b", "x"]
    docs = spark.createDataFrame([("en", t) for t in texts], "lang string, text string").coalesce(1)
    rows = quality.gram_rows(docs).collect()
    assert len({(r.part, r.shard) for r in rows}) == len(rows)
    shares, contexts = quality.fitted(docs)
    quality.sharded(shares, contexts, str(tmp_path / "model"))
    found = {}
    for row in quality.gram_bits(quality.gram_rows(docs), f"file://{tmp_path}/model").collect():
        grams = quality.unpacked(row.grams, quality.ORDER)
        found |= zip(map(tuple, grams.tolist()), np.frombuffer(row.bits), strict=True)
    for text in texts:
        codes, _, _ = quality.characters([text])
        own = [found[tuple(codes[k : k + 5].tolist())] for k in range(len(text) + 1)]
        assert sum(own) == pytest.approx(brute_bits(texts, text), rel=1e-9)


def test_a_few_toxic_words_in_ordinary_text(spark, tmp_path):
    pick = random.Random(9)
    good = lambda: " ".join(pick.choice("the cat sat on a mat and ran 12 far".split()) for _ in range(300))
    toxic = lambda: f"{good()} nomat nosat {good()}"
    rows = [(n, good(), "en") for n in range(60)] + [(n, toxic(), "en") for n in range(100, 112)]
    rows += [(n, toxic(), "en") for n in (200, 201)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs.write.parquet(str(tmp_path / "docs"))
    marks = [(n, 1, 0) for n in range(60)] + [(n, 1, 1) for n in range(100, 112)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality(spark.read.parquet(str(tmp_path / "docs")), labels).collect()}
    for n in (200, 201):
        assert got[n].toxic_score > got[n].toxic_threshold and not got[n].kept
    assert sum(got[n].kept for n in range(60)) >= 57


def brute_proximity(docs, items, least, window):
    out = {}
    for doc, text in docs:
        words = re.findall("[0-9a-z]+", (text or "").lower())
        for item, phrase in items:
            own = re.findall("[0-9a-z]+", phrase.lower())
            size = min(window, len(own))
            for j in range(len(own) - size + 1) if own else ():
                for start in range(-size + 1, len(words)):
                    same = sum(
                        0 <= start + k < len(words) and words[start + k] == own[j + k] for k in range(size)
                    )
                    if same and same / size >= least:
                        key = doc, item, start
                        out[key] = max(out.get(key, 0.0), same / size)
    return out


def test_proximity_of_all_alignments(spark):
    pick = random.Random(12)
    letters = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split()
    items = [(n, " ".join(pick.choice(letters) for _ in range(size))) for n, size in enumerate((40, 25, 13, 14, 6, 1))]
    items.append((9, " ".join(f"rare{k}" if k % 7 == 3 else "a" for k in range(25))))
    docs = [(1, None), (2, ""), (3, "a b c")]
    for n in range(10, 60):
        own = pick.choice(items)[1].split()
        at = pick.randrange(len(own))
        copy = own[at : at + pick.choice((13, 13, 16, 25))]
        for _ in range(pick.randrange(4)):
            copy[pick.randrange(len(copy))] = "other"
        docs.append((n, " ".join([pick.choice(letters) for _ in range(pick.randrange(9))] + copy + ["end"] * (n % 3))))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for least in (0.8, 0.7, 1.0):
        got = decontaminate.proximity(made_docs(spark, docs), bench, least=least).collect()
        assert {(r.doc_id, r.item_id, r.start): r.share for r in got} == brute_proximity(docs, items, least, 13)
        assert len(got) == len({(r.doc_id, r.item_id, r.start) for r in got})
