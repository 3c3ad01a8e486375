"""Every operator against brute force or the tokenizers library, on texts with all the awkward cases."""

import hashlib
import random
import re
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from labelscan.llm import bottom_k, bpe_chunks, common, domain_mixing, nn_descent, ordinal_toxicity, pii_tagger, quality_cascade, relative_lz, token_counts, url_trust
from labelscan.llm.pretokens import read_tokenizer

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def split(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def texts():
    r = random.Random(5)
    vocabulary = ["".join(r.choice("aeionrstlé") for _ in range(r.randint(1, 8))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    base, passage = prose(120), prose(40)
    near = base.split()
    near[60] = "changed"
    return [
        None, "", " \n\t ", "word", "a b c d", "A b C d e f g", base, base, " ".join(near), base.upper(), prose(70) + "\n" + passage + " " + prose(30),
        passage, prose(25) + " " + passage, passage + " " + passage, "x " * 200, prose(3000), "ab" * 3000, "don't  'll we'RE <|endoftext|> x  <|endoftext|>",
        "日本語 テキスト。" * 40, "mail a.b@c-d.example.com, +1 (771) 555-1655 or 10.0.0.255, 256.1.1.1 card 4111 1111 1111 1111.", "a@b@c.de +1 2 1.2.3.4.5.6.7.8",
        "\x85  'éᲉ ½²", "same line\nsame line\nother\nsame line\n", "#*$% " * 60,
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts())]
    rows += [(None, "null id with some words in it", None, None, None), rows[6], rows[6], (7, "another text of seven", "de", None, None)]
    frame = spark.createDataFrame(rows, DOCS)
    # extra columns whose names clash with results and, but for case, with inputs
    return frame.select("*", F.lit("x").alias("n_tokens"), F.lit("y").alias("TEXT"), F.lit(3).alias("key"), F.lit(4).alias("kept"))


def rows_of(docs):
    return [(r[0], r[1]) for r in docs.collect()]


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_token_counts(docs, none):
    t = Tokenizer.from_file(TOKENIZER)
    found = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, TOKENIZER).collect())
    expected = []
    for d, x in rows_of(docs):
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        expected.append((d if d is not None else -1, len((x or "").encode()), n, n > 512))
    assert found == sorted(expected)
    assert token_counts.token_counts(none, TOKENIZER).count() == 0


def test_transducer_on_random_strings_and_small_chunks():
    r, t = random.Random(1), Tokenizer.from_file(TOKENIZER)
    alphabet = "aàé'sdrelmtvLN12 ½ \n\t 　.,!-<|🙂日本_"
    samples = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 50))) for _ in range(800)]
    expected = [len(e.ids) for e in t.encode_batch(samples, add_special_tokens=False)]
    counter = token_counts.Counter(read_tokenizer(TOKENIZER))
    for chunk in (2, 5, 1 << 14):
        assert counter.count(samples, chunk).tolist() == expected


def test_encode_decode(docs, none):
    t = Tokenizer.from_file(TOKENIZER)
    key = lambda x: (x[0] if x[0] is not None else -1, x[1])
    found = [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), r.decoded, r.n_tokens, r.ids_sha256) for r in bpe_chunks.encode_decode(docs, TOKENIZER).collect()]
    expected = []
    for d, x in rows_of(docs):
        ids = t.encode(x or "", add_special_tokens=False).ids
        expected.append((d, ids, t.decode(ids, skip_special_tokens=False), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()))
    assert sorted(found, key=key) == sorted(expected, key=key)
    assert bpe_chunks.encode_decode(none, TOKENIZER).count() == 0


def test_shared_chunks_are_encoded_once_and_cut_alike():
    r = random.Random(2)
    body = bytes(r.choice(b"abcdefg ") for _ in range(20_000))

    def cuts(raw):
        at = bpe_chunks.cut(np.frombuffer(raw, np.uint8))
        return {raw[a:b] for a, b in pairwise(at)}

    assert len(cuts(body) & cuts(b"another beginning " + body)) > 8


def test_substring_dedup(docs, none):
    rows = sorted(((float("inf") if d is None else d, x or "") for d, x in rows_of(docs)))
    seen, expected = set(), []
    for d, x in rows:
        w = split(x)
        gone = set()
        for i in range(len(w) - 19):
            window = tuple(w[i : i + 20])
            if window in seen:
                gone |= set(range(i, i + 20))
            seen.add(window)
        kept = " ".join(y for i, y in enumerate(w) if i not in gone)
        expected.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    found = [(float("inf") if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in relative_lz.remove_repeats(docs).collect()]
    assert sorted(found) == sorted(expected)
    assert relative_lz.remove_repeats(none).count() == 0


def near_by_brute_force(rows):
    sets = []
    for _, x in rows:
        w = split((x or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = {d: d for d, _ in rows}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                x, y = sorted((find(rows[i][0]), find(rows[j][0])))
                root[y] = x
    return [(d, len(s), None if d is None else find(d), d is None or find(d) == d) for (d, _), s in zip(rows, sets, strict=True)]


def near_found(docs):
    return [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in bottom_k.near_duplicates(docs).collect()]


def by_id(rows):
    return sorted(rows, key=lambda x: (-1 if x[0] is None else x[0], x[1]))


def test_near_duplicates(docs, none):
    assert by_id(near_found(docs)) == by_id(near_by_brute_force(rows_of(docs)))
    assert near_found(none) == []


def test_near_duplicates_in_a_long_list(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    base, rows = [word() for _ in range(150)], []
    for i in range(90):
        w = list(base)
        for _ in range(i % 6):
            w[r.randrange(150)] = word()
        rows.append((i * 3 % 91, " ".join(w)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_id(near_found(frame)) == by_id(near_by_brute_force(rows))


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 130)]
    root = {x: x for e in edges for x in e}
    for _ in range(70):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    found = dict(common.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(found.get(x, x) == y for x, y in root.items())


def test_quality_rules(docs, none):
    found = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_cascade.quality_report(docs).collect()}
    expected = set()
    for d, x in rows_of(docs):
        w, x = split(x), x or ""
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        repeated = {i + j for i, v in enumerate(windows) if windows.count(v) > 1 for j in range(3)}
        lines = [y for y in x.split("\n") if split(y)]
        failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
        expected.add((d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in x), len(lines) - len(set(lines)), len(repeated), failed))
    assert found == expected
    assert quality_cascade.quality_report(none).count() == 0
    judged = {(r.doc_id, r.rejected_by is None) for r in quality_cascade.quality(common.pick(docs, doc_id="long", text="string")).collect()}
    kept = {(r.doc_id, r.kept) for r in quality_cascade.quality_report(docs).collect()}
    assert judged == kept


def test_the_order_of_the_rules_does_not_change_the_verdict(docs):
    rows = common.pick(docs, doc_id="long", text="string")
    found = quality_cascade.rules()
    order = list(found)
    one, other = (rows.select("doc_id", quality_cascade.verdict(found, o).isNull().alias("k")) for o in (order, order[::-1]))
    assert sorted(map(str, one.collect())) == sorted(map(str, other.collect()))


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_by_patterns(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and pii_tagger.luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], list(BASE).index(s[2])))


def test_base_spans_follow_the_patterns():
    r = random.Random(8)
    for _ in range(3000):
        text = "".join(r.choice("aZ0123456789@.+-() %_\né") for _ in range(r.randint(0, 60)))
        assert pii_tagger.base_spans(text) == base_by_patterns(text)
    for text in (x or "" for x in texts()):
        assert pii_tagger.base_spans(text) == base_by_patterns(text)


def test_find_and_redact(docs, none):
    for r in pii_tagger.find_pii(docs).collect():
        base = base_by_patterns(dict(rows_of(docs)).get(r.doc_id) or "") if r.doc_id not in (None, 7) else []
        if base:
            written = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
            assert hashlib.sha256(written.encode()).hexdigest() == r.base_sha256 and set(written.split(",")) <= set(r.spans.split(","))
    clean = pii_tagger.redact(common.pick(docs, doc_id="long", text="string", n_chars="long")).where("doc_id = 19").first()
    assert "<EMAIL>" in clean.text and "4111" not in clean.text and clean.n_chars == len(clean.text)
    assert pii_tagger.find_pii(none).count() == 0


def examples(n, seed):
    r, out = random.Random(seed), []
    for _ in range(n):
        words = ["".join(r.choice("aeionrst") for _ in range(r.randint(2, 8))) for _ in range(12)]
        words[r.randrange(12)] = r.choice([f"{words[0]}.{r.randrange(99)}@mail{r.randrange(9)}.example.com", ".".join(str(r.randrange(256)) for _ in range(4)), f"+1 ({r.randrange(200, 999)}) 555-{r.randrange(1000, 9999)}", str(r.randrange(10**6))])
        out.append(" ".join(words))
    return out


def test_the_tagger_learns_the_spans():
    batch = next(pii_tagger._examples([pa.RecordBatch.from_pydict({"text": examples(1200, 1)})]))
    model = pii_tagger.Tagger()
    losses = model.train(np.array(batch.column(1).to_pylist()), np.array(batch.column(2).to_pylist()))
    held = examples(100, 2)
    right = sum(set(pii_tagger.base_spans(t)) == set(s) for t, s in zip(held, model.spans(held), strict=True))
    assert losses[-1] < losses[0] / 5 and right >= 80


def test_the_gradients_are_those_of_the_loss():
    model, r = pii_tagger.Tagger(), np.random.default_rng(1)
    chars, tags = r.integers(0, 98, (3, pii_tagger.WIDTH)), r.integers(0, pii_tagger.TAGS, (3, pii_tagger.WIDTH))
    _, g = model.gradients(chars, tags)
    for name in model.p:
        at = tuple(int(r.integers(0, n)) for n in model.p[name].shape) if name != "e" else (int(chars[0, 0]), 2)
        losses = []
        for step in (1e-5, -2e-5):
            model.p[name][at] += step
            losses.append(model.gradients(chars, tags)[0])
        model.p[name][at] += 1e-5
        assert abs((losses[0] - losses[1]) / 2e-5 - g[name][at]) < 1e-5


def test_nearest_neighbours(spark):
    r = np.random.default_rng(3)
    x = np.concatenate([c + r.normal(0, 0.3, (150, 16)) for c in r.normal(0, 1, (6, 16))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(900 + i, rows[100][1]) for i in range(30)]  # equal vectors
    rows += [(2000, None), (None, rows[0][1]), (2100, [0.0] * 16), (2200, [float("nan")] * 16), (2300, [None] * 16), (2400, [1.0]), rows[5]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    good = {d: np.array(v) for d, v in rows if d is not None and (d < 2000)}
    ids, m = np.array(sorted(good)), np.stack([good[d] for d in sorted(good)])
    found = nn_descent.neighbours(frame).collect()
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        far = np.sqrt(((m - good[q]) ** 2).sum(axis=1))
        best = [int(ids[k]) for k in np.lexsort((ids, far)) if ids[k] != q][:10]
        mine = sorted((s.rank, s.vec_id, s.score) for s in found if s.query_id == q)
        assert [s[0] for s in mine] == list(range(1, 11))
        assert all(abs(far[list(ids).index(v)] - s) < 1e-12 for _, v, s in mine)
        hits, total = hits + len(set(best) & {v for _, v, _ in mine}), total + 10
    assert {s.query_id for s in found} == set(ids[ids % 100 == 0].tolist()) and hits >= 0.9 * total
    assert nn_descent.neighbours(frame.limit(0)).count() == 0
    few = spark.createDataFrame(rows[98:103], "vec_id long, embedding array<double>")
    assert nn_descent.neighbours(few).count() == 4


PAGES = [
    (1, "https://a.example.com/en/1?x", '<a href="http://bad.example.net/fr/">'), (2, "http://WWW.Example.com/en/x", None), (3, "http://bad.example.net/fr/2", ""),
    (4, "http://bad.example.net/de/2", '<a href="//c.example.org/x">'), (5, "http://c.example.org", None), (6, None, None), (7, "no host", "x"), (8, "http://lone/path#x", None),
    (9, "http://shop.com/en/", '<a href=https://c.example.org>'), (10, "http://shop.com", None), (None, "ftp://x.net/es/1", None), (5, "http://c.example.org", None),
]


def trust_by_hand(rounds=url_trust.ROUNDS, damping=url_trust.DAMPING):
    edges, good, bad = {}, {}, {}
    put = lambda a, b, w=1.0: edges.__setitem__((a, b), edges.get((a, b), 0) + w)
    hosts, pairs = set(), set()
    for _, url, html in PAGES:
        host = url.split("://")[1].split("/")[0].split("#")[0].split("?")[0].lower() if url and "://" in url else ""
        if host:
            hosts.add(host)
            for target in re.findall(r'href="?(?:https?:)?//([^/">]+)', html or ""):
                put(host, target)
                hosts.add(target)
    for h in hosts:
        labels = h.split(".")
        for i in range(len(labels) - 2):
            pairs.add((".".join(labels[i:]), ".".join(labels[i + 1 :])))
    for a, b in pairs:
        put(a, b)
        put(b, a)
    good = {"a.example.com": 0, "www.example.com": 1, "shop.com": 1}
    bad = {"a.example.com": 1, "bad.example.net": 1, "x.net": 1}
    nodes = {x for e in edges for x in e} | hosts
    start_t, start_d = ({n: s.get(n, 0) / sum(s.values()) for n in nodes} for s in (good, bad))
    out, into = ({n: sum(w for e, w in edges.items() if e[i] == n) for n in nodes} for i in (0, 1))
    t, d = dict(start_t), dict(start_d)
    for _ in range(rounds):
        nt, nd = ({n: (1 - damping) * s[n] for n in nodes} for s in (start_t, start_d))
        for (a, b), w in edges.items():
            nt[b] += damping * t[a] * w / out[a]
            nd[a] += damping * d[b] * w / into[b]
        for n in nodes:
            nt[n] += damping * t[n] * (not out[n])
            nd[n] += damping * d[n] * (not into[n])
        t, d = nt, nd
    return t, d


def test_url_trust(spark):
    frame = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    found = {r.page_id: r for r in url_trust.judge(frame).collect()}
    assert url_trust.judge(frame).count() == len(PAGES) and url_trust.judge(frame.limit(0)).count() == 0
    rules = {1: "example.com/en/", 2: "www.example.com/en/", 3: "net/fr/", 4: None, 5: None, 6: None, 7: None, 8: None, 9: "com/", 10: None, None: "net/es/"}
    assert {k: r.rule for k, r in found.items()} == rules
    assert (found[2].host, found[2].path, found[10].path, found[6].host, found[8].path) == ("www.example.com", "/en/x", "", "", "/path")
    t, d = trust_by_hand()
    for k in (4, 5, 8, 10):
        host = found[k].host
        assert abs(found[k].trust - t[host]) < 1e-12 and abs(found[k].distrust - d[host]) < 1e-12
        assert found[k].verdict == ("block" if d[host] > t[host] + 1e-12 else "allow")
    assert found[1].verdict == "block" and found[9].verdict == "allow" and found[6].verdict == "allow"


SF = "/root/testdata/sf0.01"


def test_toxicity_on_held_out_labels(spark):
    # the smaller tables have too few toxic documents for a figure
    larger = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{larger}/documents.parquet"), spark.read.parquet(f"{larger}/labels.parquet")
    held = F.col("doc_id") % 4 == 0
    scored = ordinal_toxicity.severity(docs, labels.where(~held)).withColumnRenamed("toxic", "judged")
    rows = scored.join(labels.where(held), "doc_id").collect()
    assert np.mean([r.judged == (r.toxic == 1) for r in rows]) >= 0.95
    assert all(0 <= r.severity <= 2 for r in rows)


def test_toxicity_of_awkward_rows(docs, none, spark):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 1), (6, None, 1), (6, 0, 1)], "doc_id long, quality int, toxic int")
    assert ordinal_toxicity.severity(docs, labels).count() == docs.count()
    assert ordinal_toxicity.severity(docs, labels.limit(0)).where("toxic").count() == 0
    assert ordinal_toxicity.severity(none, labels).count() == 0


def test_mixing_matches_the_targets(spark, docs, none):
    table, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    targets = {"good": 0.9, "poor": 0.07, "toxic": 0.03}
    rows = domain_mixing.mix(table, labels, targets).collect()
    mass = np.array([[r[f"p_{d}"] * r.tokens * r.rate for d in targets] for r in rows]).sum(axis=0)
    assert len(rows) == table.count() and np.abs(mass / mass.sum() - list(targets.values())).max() < 1e-3
    assert all(r.rate >= 0 and int(r.rate) <= r.copies <= int(r.rate) + 1 for r in rows)
    awkward = domain_mixing.mix(docs, labels.limit(0), targets)
    assert awkward.count() == docs.count() and domain_mixing.mix(none, labels, targets).count() == 0
    assert all(r.rate == 1 for r in awkward.where("tokens = 0").collect())
