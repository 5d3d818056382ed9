"""Long texts, clashing names, repeated ids and independent twins of the training-data operators."""

import hashlib
import random
import re
import string
import time
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from linkloom.llm import byte_bpe, chat_format, decontaminate, html_extract, html_train, importance, line_dedup, ngram_join, quality_rules, secret_scan, secret_train, token_counts

SCHEMA = "doc_id long, text string"
SMALL = "/root/testdata/sf0.01"


def docs_of(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    for name, value in more.items():
        df = df.withColumn(name, F.lit(value))
    return df


# Operator 2


@pytest.fixture(scope="module")
def unigram():
    sentencepiece = pytest.importorskip("sentencepiece")
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = pytest.importorskip("sentencepiece.sentencepiece_model_pb2").ModelProto()
    model.ParseFromString(open(path, "rb").read())
    model.trainer_spec.model_type = 1
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString()), token_counts.load_counts(path)


def test_token_counts_of_whole_texts(unigram):
    sp, counts = unigram
    texts = [t for t in pq.read_table(f"{SMALL}/documents.parquet", columns=["text"]).column("text").to_pylist() if t]
    r = random.Random(1)
    texts += ["  two  spaces ", " ", "▁", "a▁b", "\n\n\n", "x" * 3000, "日本語 テキスト\n" * 50, "".join(r.choices("ab \n▁é日", k=2000)), "word\n" * 400]
    wrong = [t[:60] for t in texts if token_counts.count_tokens(t, counts) != len(sp.encode(t))]
    assert not wrong


def test_token_scores_that_are_no_whole_numbers():
    r = random.Random(3)
    pieces = {"▁": -2.5, **{c: -3.25 - i / 7 for i, c in enumerate("abc")}, "ab": -4.1, "▁a": -3.3, "bc": -5.7, "abc": -6.6}
    lexicon = token_counts.Lexicon(pieces, False)
    assert not lexicon.whole
    one = {p: np.float32(s) for p, s in pieces.items()}
    unknown = np.float32(min(one.values()) - np.float32(10))
    for _ in range(100):
        t = "▁" + "".join(r.choices("abc▁x", k=r.randint(1, 40)))
        best = [(np.float32(0), 0)] + [None] * len(t)
        for at in range(len(t)):
            single = False
            for n in range(1, 4):
                if t[at : at + n] in one and at + n <= len(t):
                    single |= n == 1
                    s = np.float32(best[at][0] + one[t[at : at + n]])
                    if best[at + n] is None or s > best[at + n][0]:
                        best[at + n] = s, best[at][1] + 1
            if not single and (best[at + 1] is None or best[at][0] + unknown > best[at + 1][0]):
                best[at + 1] = np.float32(best[at][0] + unknown), best[at][1] + 1
        assert lexicon.count(t) == best[-1][1]


# Operator 4


def test_decontaminate_recall_near_the_threshold(spark):
    """SimHash may lose windows in principle: all pairs of similarity 0.75 to 0.9 must be found."""
    r = random.Random(8)
    word = lambda: "".join(r.choices(string.ascii_lowercase, k=r.randint(3, 7)))
    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    items, texts, want = [], [], {}
    while len(items) < 300:
        item = [word() for _ in range(r.choice([40, 60, 90, 150]))]
        near = list(item)
        for _ in range(r.randint(1, 4)):
            near[r.randrange(len(near))] = word()
        a, b = grams(item), grams(near)
        common = sum((a & b).values())
        similarity = common / (sum(a.values()) + sum(b.values()) - common)
        if 0.75 <= similarity < 0.9:
            want[len(items), len(items)] = round(similarity, 9)
            texts.append((len(items), " ".join([word() for _ in range(30)] + near + [word() for _ in range(30)])))
            items.append((len(items), " ".join(item)))
    got = {(x.doc_id, x.item_id): round(x.similarity, 9) for x in decontaminate.contaminated(docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == set(want) and all(got[k] >= v for k, v in want.items())


def test_decontaminate_long_texts(spark):
    item = " ".join(f"w{i}" for i in range(30))
    rows = [(1, (item + " ") * 2500), (None, "x " * 10 + item), (None, "clean text " * 20), (2, " ".join(f"v{i}" for i in range(200_000)))]
    began = time.time()
    got = decontaminate.contaminated(docs_of(spark, rows, item_id=1, m=2, words=3, t=4), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert sorted((x.doc_id is None, x.first_word, x.similarity) for x in got) == [(False, 0, 1.0), (True, 10, 1.0)]
    assert time.time() - began < 60


# Operator 5


def test_kth_highest(spark):
    r = random.Random(2)
    values = [r.gauss(0, 1) ** 5 for _ in range(3000)] + [0.25] * 500 + [1e9, -1e9]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(7)
    for k in (1, 2, 700, 1600, 3502, 9999):
        assert importance.kth_highest(df, k) == sorted(values, reverse=True)[min(k, len(values)) - 1]
    assert importance.kth_highest(df.where("false"), 3) is None


def test_importance_scores_and_top_k(spark):
    """Scores, noise and selection against a plain version."""
    r = random.Random(4)
    text = lambda s: " ".join("".join(r.choices(s, k=2)) for _ in range(r.randint(2, 60)))
    rows = [(i, text(["th", "er", "on"])) for i in range(60)] + [(100 + i, text(["xx", "#q"])) for i in range(40)] + [(900, None), (901, ""), (None, "a"), (5, "again")]
    labels = [(i, 1, 0) for i in range(30)] + [(100 + i, 0, 0) for i in range(20)]
    docs = docs_of(spark, rows, _score=1, _KEPT="x", target=True, bucket=2)
    out = importance.resample(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), k=70)
    got = out.collect()
    assert out.columns == ["doc_id", "text", "target", "bucket", "_score", "_noisy", "_passage", "_kept"]

    def grams(t):
        data = (t or "").encode()
        words = data.split()
        at = np.array([0, len(data)])
        out = []
        for kind, (bucket, _) in enumerate(importance._grams(np.frombuffer(data, np.uint8), at)):
            assert len(bucket) == (max(0, len(data) - 2), len(words), max(0, len(words) - 1))[kind]
            out += bucket.tolist()
        return out

    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(grams(t))
        if i is not None and i < 30:
            target.update(grams(t))
    n = importance.BUCKETS
    total = lambda c, kind: sum(v for b, v in c.items() if b // n == kind) + n
    ratio = {b: np.log((target[b] + 1) / total(target, b // n)) - np.log((raw[b] + 1) / total(raw, b // n)) for b in raw}
    for x in got:
        own = grams(x.text)
        assert abs(x._score - sum(ratio[b] for b in own) / (len(own) + importance.SHRINK)) < 1e-5
        assert x._noisy > x._score / importance.TEMPERATURE - 5
    line = sorted((x._noisy for x in got), reverse=True)[69]
    lowest = max((x._passage for x in got if not x._kept and x._noisy >= line), default=None)
    assert all(x._kept == (x._noisy >= line and (lowest is None or x._passage > lowest)) for x in got)
    assert importance.resample(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), k=0).where("_kept").count() == 0


# Operator 6


def python_candidates(t):
    return [(m.start(), m.group()) for m in regex.finditer(secret_scan.CANDIDATE, t)]


def python_features(c, before, after):
    dictionary = "|".join(secret_scan.DICTIONARY)
    has = lambda p, s: float(bool(regex.search(p, s)))
    n = len(c)
    kinds = [(string.digits, "0"), (string.ascii_lowercase, "a"), (string.ascii_uppercase, "A")]
    kind = lambda ch: next((k for s, k in kinds if ch in s), "")
    return {
        "length": float(min(n, 200)),
        "transitions": sum(kind(a) != "" and kind(a) != kind(b) for a, b in zip(c, c[1:])) / n,
        "digits": sum(ch in string.digits for ch in c) / n,
        "upper": sum(ch in string.ascii_uppercase for ch in c) / n,
        "marks": sum(ch in "+/_-" for ch in c) / n,
        "distinct": len(set(c)) / min(n, 40),
        "dictionary": 1 - len(regex.sub(dictionary, "", c.lower())) / n,
        "hex": float(bool(re.fullmatch("[0-9a-f]+", c) or re.fullmatch("[0-9A-F]+", c))),
        "longest_run": has(r"(.)\1{4}|01234|12345|abcdef", c),
        "path": float(bool(re.search(r"[/.@]\Z|://[^ ]*\Z", before) or re.match(r"[.][a-z]|[/@]", after))),
        "assigned": float(bool(re.search(r"[=:]\s{0,2}[\"']?\Z", before) or re.search(r"(?i)bearer \Z", before))),
        "secret_word": has(r"(?i)secret|token|passw|api.?key|access.?key|auth|bearer|credential|private", before),
        "hash_word": has(r"(?i)sha\d*|md5|commit|checksum|digest|uuid|etag|revision|hash|build|isbn|order|invoice|phone|iban", before),
        "quoted": has(r"[\"']\Z", before),
        "equals": has(r"=\s{0,2}[\"']?\Z", before),
        "code": has(r"[.({$\[][A-Za-z]|[)}]\Z", c),
        "state_word": has(r"(?i)\A(none|null|nil|true|false|required|optional|string|hidden|missing|changed|expired|invalid|empty|unset|below|see|is|reset|redacted|[*x.-]+)\Z", c),
        "in_address": float(bool(re.search(r"[a-z]://[^\s/:@]*:\Z", before) and after.startswith("@"))),
        "signed": has(r"\AeyJ[^.]+[.][^.]+[.]", c),
        "sample_word": has(r"(?i)example|sample|dummy|placeholder|your|xxxx|test", before[-16:] + c),
    }


def test_secret_scan_twin(spark):
    """Candidates, features and scores against a plain Python version."""
    r = random.Random(11)
    texts = [secret_train.finding(r)[0] for _ in range(250)]
    texts += ["\n".join(texts[i : i + 40]) for i in range(0, 200, 40)] + ["a " * 40 + "é token=日本 x", "key=" * 30, "/".join(["abc1"] * 60)]
    rows = list(enumerate(texts)) * 1 + [(0, texts[0]), (None, texts[1])]
    got = Counter((x.doc_id, x.start, x.secret, x.score) for x in secret_scan.scan(docs_of(spark, rows, c="q", start=1, found=2, n0=3, before=4)).collect())
    forest = secret_scan.load_forest()
    want = Counter()
    for i, t in rows:
        for at, c in python_candidates(t):
            f = python_features(c, t[max(0, at - secret_scan.BEFORE) : at], t[at + len(c) : at + len(c) + secret_scan.AFTER])
            want[i, at, c, round(secret_train.predict(forest, f), 6)] += 1
    assert got == want


def test_secret_scan_long_text(spark):
    r = random.Random(12)
    keys = ["".join(r.choices(string.ascii_letters + string.digits, k=31)) + "7" for _ in range(60_000)]
    text = " ".join(keys) + " " + "x" * 3_000_000
    began = time.time()
    got = secret_scan.scan(docs_of(spark, [(1, text)])).select("start", "secret").collect()
    assert sorted((x.start, x.secret) for x in got)[: len(keys)] == [(33 * j, k) for j, k in enumerate(keys)]
    assert time.time() - began < 90


def test_secret_kinds(spark):
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9P"
    rows = [(1, f"Authorization: Bearer {jwt} ok"), (2, "db postgres://app:Zk3vQw9LmP2x@db.example.com/x"), (3, "password=hunter2!"), (4, 'api_key="aB3dE5fG7hI9"'), (5, 'token = "' + "qWmZxKvTbNpLsDfGhJkRtYuIoPaScV" + '"')]
    found = {(x.doc_id, x.secret) for x in secret_scan.scan(docs_of(spark, rows)).where("is_secret").collect()}
    assert (1, jwt) in found and (2, "Zk3vQw9LmP2x") in found and (4, "aB3dE5fG7hI9") in found and {i for i, _ in found} >= {1, 2, 4, 5}


# Operator 7


def test_chat_format_long_and_clashing(spark):
    rows = [(1, 0, 0, "start", "user", "q" * 2_000_000), (1, 1, 0, "start", "assistant", "<|im_end|>" * 20_000)]
    log = spark.createDataFrame(rows, chat_format.EVENTS)
    for c in ("formatted", "message_no", "loss", "escaped", "n_turns"):
        log = log.withColumn(c, F.lit(1))
    (x,) = chat_format.read_back(chat_format.format_conversations(log)).collect()
    assert x.n_turns == 2 and x.loss_chars == 200_000 and x.loss_sha256 == hashlib.sha256(b"<|im_end|>" * 20_000).hexdigest()


# Operator 8


def test_prefixes_and_edits():
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as p

    v = byte_bpe.codec(p.path("byte_bpe_50k.tiktoken"))[0]
    enc = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    r = random.Random(5)
    e = byte_bpe.PrefixEncoder(v, bytes(r.choices(b"the in goa.", k=80)))
    assert all(e.last[k] == enc._encode_single_piece(e.data[:k])[-1] for k in range(1, 81))
    for _ in range(100):
        a = r.randint(0, len(e.data))
        b = r.randint(a, min(len(e.data), a + 5))
        e.replace(a, b, bytes(r.choices(b"thein 1\n", k=r.randint(0, 5))))
        assert e.last == byte_bpe.PrefixEncoder(v, e.data).last
        assert e.ids() == enc._encode_single_piece(e.data)
    long = byte_bpe.PrefixEncoder(v, bytes(r.choices(b"abcdefgh ij", k=20_000)))
    assert long.replace(100, 103, b"xyz") < 2000  # not to the end


def test_byte_bpe_whole_table():
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as p

    path = p.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=byte_bpe.codec(path)[0].ranks, special_tokens={})
    texts = [t or "" for t in pq.read_table(f"{SMALL}/documents.parquet", columns=["text"]).column("text").to_pylist()]
    texts += ["".join(map(chr, range(lo, min(lo + 4096, 0xD800 if lo < 0xD800 else 0x110000)))) for lo in [*range(0, 0xD800, 4096), *range(0xE000, 0x30000, 4096)]]
    assert all(b"".join(byte_bpe.encode(t, path, p.PATTERN)) == np.array(enc.encode_ordinary(t), "<u4").tobytes() for t in texts)


# Operator 9


def test_line_dedup_repeated_ids_and_names(spark):
    line = "A line that many documents hold."
    rows = [(1, line), (2, line), (2, "x\n" + line), (3, "own\n\n" + line.upper() + "\n" + line), (None, line), (None, line)]
    docs = docs_of(spark, rows, _b=1, _lines=2, _n_lines="z", _KEPT=3, _gone=4, _owner=5, h1=6, pos=7)
    out = line_dedup.dedup_lines(docs)
    got = sorted(((x.doc_id or 0, x._n_lines, x._n_dropped, x.text) for x in out.collect()))
    assert got == [(0, 1, 1, ""), (0, 1, 1, ""), (1, 1, 1, ""), (2, 1, 1, ""), (2, 2, 1, "x"), (3, 4, 0, rows[3][1])]
    assert {"_b", "_lines", "_KEPT", "_gone", "_owner", "h1", "pos"} <= set(out.columns)
    two = line_dedup.dedup_lines(docs_of(spark, [(1, line), (2, line), (2, line)]))
    assert two.agg(F.sum("_n_dropped")).first()[0] == 0  # two documents hold it, in three rows
    long = [(i, "\n".join(f"line number {j} of a long text" for j in range(i, 30_000 + i))) for i in range(3)]
    exact = {x.doc_id: x._n_dropped for x in line_dedup.dedup_lines(docs_of(spark, long)).collect()}
    assert exact == {0: 29_998, 1: 29_998, 2: 0}


# Operator 10


@pytest.fixture(scope="module")
def model():
    return html_extract.load_model()


def test_html_quotes(model):
    text = lambda h: [b[1] for b in html_extract.blocks(h)]
    assert text('<article><p title=5">Hello there</p><p class="x">World</p></article>') == ["Hello there", "World"]
    assert text("<a href=/it's>go</a><p>on</p>") == ["go", "on"]
    assert text('<p class="a>b" id=\'c>d\'>x</p><script data-x="a>b">"</p>"</script>y') == ["x", "y"]
    assert text("<p>open <b>bold<p>next <i") == ["open bold", "next"]
    assert text("") == [] and text("<") == ["<"] and text("a < b &lt; c") == ["a < b < c"]


def plain_labels(page, m):
    """The network with loops over single numbers."""
    paths, words, figures = html_extract.features(page)
    sig = lambda z: 1 / (1 + np.exp(-z))
    mean = lambda slots, e: np.mean([e[s] for s in slots], axis=0)
    x = [np.concatenate([mean(p, m["path"]), mean(w, m["word"]), f]) for p, w, f in zip(paths, words, figures)]

    def one_way(steps, w, b):
        h, c, out, k = np.zeros(html_extract.HIDDEN), np.zeros(html_extract.HIDDEN), [], html_extract.HIDDEN
        for v in steps:
            z = np.concatenate([v, h]) @ w + b
            c = sig(z[k : 2 * k]) * c + sig(z[:k]) * np.tanh(z[3 * k :])
            h = sig(z[2 * k : 3 * k]) * np.tanh(c)
            out.append(h)
        return out

    ahead, back = one_way(x, m["wf"], m["bf"]), one_way(x[::-1], m["wb"], m["bb"])[::-1]
    return [float(np.concatenate([a, b]) @ m["v"] + m["v0"]) for a, b in zip(ahead, back)]


def test_html_network_twin(model):
    r = random.Random(21)
    pages = [html_extract.blocks(html_train.page(r)[0]) for _ in range(40)]
    for page, got in zip(pages, html_extract.label(pages, model)):
        want = plain_labels(page, model)
        assert all(abs(w) < 1e-3 or (w > 0) == g for w, g in zip(want, got))


def test_html_held_out(model):
    held = html_train.examples(300, 1234)
    right = [np.mean(g == t) for g, (_, t) in zip(html_extract.label([p for p, _ in held], model), held)]
    assert np.mean(right) > 0.99


def test_html_unseen_structure(model):
    body = "".join(f"<p>{' '.join(['Quite', 'another', 'sort', 'of', 'words'] * n)}.</p>" for n in (4, 9, 2, 12))
    page = f'<body><header class="qx"><a href=/>Brand</a></header><nav class="zz9"><ul><li><a href=/a>Alpha</a><li><a href=/b>Beta</a></ul></nav><main class="uvw"><article class="k17"><h1>Some heading here</h1>{body}</article></main><aside class="r2"><p>Elsewhere on this site you find more.</p></aside><footer class="f0">All rights reserved</footer></body>'
    (text,) = html_extract.main_text([page], model)
    assert text.split("\n") == ["Some heading here", *[" ".join(["Quite", "another", "sort", "of", "words"] * n) + "." for n in (4, 9, 2, 12)]]


def test_html_edges(spark):
    schema = "page_id long, url string, html string"
    assert html_extract.extract_pages(spark.createDataFrame([], schema)).count() == 0
    long = "<article><p>" + "a long text " * 200_000 + "</p></article>"
    many = "<article>" + "<p>Short text of an article.</p>" * 20_000 + "</article>"
    rows = [(1, "u", long), (2, "v", many), (1, "u", long), (None, None, None)]
    got = html_extract.extract_pages(spark.createDataFrame(rows, schema).withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("x"))).collect()
    assert sorted((x.page_id or 0, x.n_chars) for x in got) == [(0, 0), (1, len("a long text " * 200_000) - 1), (1, len("a long text " * 200_000) - 1), (2, 20_000 * 26 - 1)]


# Pipeline


def tables(spark, folder, rows, items, labels):
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA + ", lang string, source string, n_chars long")
    df.withColumn("_b", F.lit(1)).withColumn("_score", F.lit(0.5)).withColumn("_lines", F.lit("z")).withColumn("h", F.lit(3)).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_pipeline_nulls_repeats_and_leaks(spark, tmp_path):
    r = random.Random(31)
    text = lambda n: " ".join("".join(r.choices(["th", "er", "ing", "on", "and"], k=2)) for _ in range(n))
    item = text(40)
    same, free, bad = text(60), text(60), [" ".join("".join(r.choices("#$%&*", k=6)) for _ in range(60)) for _ in range(40)]
    good = [(i, text(r.randint(20, 80))) for i in range(100, 200)]
    rows = good + [(1000 + i, t) for i, t in enumerate(bad)] + [(1, same), (2, same + " more"), (2, free), (2, free), (3, same + " tail"), (None, same), (None, text(50)), (None, f"{text(20)} {item} {text(9)}"), (4, item), (5, text(45)), (5, f"{item} end")]
    rows += [rows[0], (6, None), (7, "")]
    folder = str(tmp_path)
    tables(spark, folder, rows, [(1, item), (2, None)], [(i, 1, 0) for i in range(100, 160)] + [(1000 + i, 0, 0) for i in range(20)])
    out = corpus_pipeline.run(spark, folder).collect()
    got = Counter(x.doc_id for x in out)
    assert got[1] == 1 and got[2] == 1 and got[3] == 0 and got[4] == 0 and got[5] == 1 and got[None] == 1
    assert all(got[i] == 1 for i, _ in good) and not any(got[1000 + i] for i in range(40))


def test_pipeline_empty_table(spark, tmp_path):
    folder = str(tmp_path)
    tables(spark, folder, [], [], [])
    assert corpus_pipeline.run(spark, folder).count() == 0


# Operators 1 and 3


def test_quality_rules_order_is_free(spark):
    r = random.Random(41)
    rows = [(i, " ".join(r.choices(["word", "####", "ABC", "!!", "a"], k=r.randint(0, 60)))) for i in range(200)] + [(None, None), (1, "x " * 100_000)]
    docs = docs_of(spark, rows, words=1, n_words="q", placed=2, lines=3)
    verdicts = [Counter((x.doc_id, x.kept) for x in quality_rules.score_documents(docs, rules, 50).collect()) for rules in (quality_rules.RULES, quality_rules.RULES[::-1])]
    assert verdicts[0] == verdicts[1]


def test_ngram_join_long_texts_and_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK_SHINGLES", 500)
    monkeypatch.setattr(ngram_join, "BUCKET_SHINGLES", 800)
    r = random.Random(43)
    words = [f"w{i}" for i in range(5000)]
    long = r.choices(words, k=30_000)
    near = long[:29_000] + r.choices(words, k=1000)
    rows = [(3, " ".join(long)), (2, " ".join(near)), (9, " ".join(long[:15_000]))] + [(10 + i, " ".join(r.choices(words, k=30))) for i in range(200)]
    rows += [(300 + i, rows[50][1] + f" end{i}") for i in range(40)]
    got = {x.doc_id: x.component_id for x in ngram_join.join_documents(docs_of(spark, rows, k=1, chunk=2, h=3, n=4)).collect()}
    assert got[3] == 2 and got[2] == 2 and got[9] == 9 and all(got[300 + i] == rows[50][0] for i in range(40))


def test_ngram_join_large_cluster_is_linked_in_time():
    r = np.random.default_rng(47)
    held = np.zeros((3000, 2400), np.float32)  # near copies of one text of 400 shingles
    for row, m in zip(held, r.choice([2, 20, 40, 60, 80, 90, 110], len(held)), strict=True):
        row[r.choice(400, 400 - m, replace=False)] = 1
        row[400 + r.choice(2000, m, replace=False)] = 1
    weight = held.sum(0).astype(np.uint32)
    order = np.lexsort((np.arange(2400), weight))
    shingle = [order[row[order] > 0].astype(np.uint64) for row in held]
    began = time.process_time()
    got = ngram_join.link_block([b"%04d" % j for j in range(len(held))], [400] * len(held), shingle, [weight[s.astype(int)] for s in shingle])
    assert time.process_time() - began < 10
    linked = 7 * (held @ held.T) >= 3 * 800
    want = np.arange(len(held))
    while True:
        low = np.minimum.reduce(np.where(linked, want, len(held)), axis=1)
        if (low == want).all():
            break
        want = low
    assert got == want.tolist() and len(set(got)) > 300


def test_ngram_join_blocks_of_a_bin_are_not_all_held_twice():
    r = np.random.default_rng(48)
    rows = []
    for block in range(6):
        words = np.sort(r.choice(1 << 50, 2400, replace=False)).astype(np.uint64)
        for j in range(250):
            t = words[np.sort(r.choice(2400, 2000, replace=False))]
            rows.append({"block": b"%d" % block, "k": b"%d-%03d" % (block, j), "n": 2000, "t": t.tobytes(), "w": np.full(2000, 208, np.uint32).tobytes()})
    binary = pa.binary()
    group = pa.Table.from_pylist(rows, pa.schema({"block": binary, "k": binary, "n": pa.int64(), "t": binary, "w": binary}))
    del rows
    tracemalloc.start()
    got = ngram_join._blocks(group)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < group.nbytes and got.num_rows == 1500
