"""Token counts, quality rules, the classifier, secret scans and LM scoring against plain versions of themselves."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folia.llm import attention_lm, common, quality_fm, quality_rules, secret_ledger, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def rows_of(df, key="doc_id"):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r[key] is None, r[key] if r[key] is not None else 0, str(r)))


def test_token_counts_equal_the_library(spark, edge, empty, tokenizer):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer)
    got = token_counts.count_tokens(edge, tokenizer, limit=100).join(edge.select("doc_id", "text").distinct(), "doc_id").collect()
    assert len(got) == edge.filter("doc_id is not null").count()
    for r in got:
        text = r.text or ""
        assert r.n_tokens == len(library.encode(text, add_special_tokens=False).ids)
        assert r.n_bytes == len(text.encode()) and r.over_limit == (r.n_tokens > 100)
    assert token_counts.count_tokens(edge, tokenizer).count() == edge.count()
    assert token_counts.count_tokens(empty, tokenizer).count() == 0


@pytest.mark.parametrize("text", ["  leading", "trailing ", "a  b", "it's we're I'd", "a\n\nb \n c", "tab\tx", "1234 56", "<|endoftext|>", "x<|endoftext|><|endoftext|>y", "é́ñ 漢字 😀😀", "\x1c\x1d x y", " ", "\n"])
def test_token_counts_of_odd_white_space(text, tokenizer):
    from tokenizers import Tokenizer

    assert token_counts.model(tokenizer).count(text) == len(Tokenizer.from_file(tokenizer).encode(text, add_special_tokens=False).ids)


def test_whole_tokens_are_proven(tokenizer):
    model = token_counts.model(tokenizer)
    assert len(model.whole) > 40_000
    assert " the" in model.whole and all(len(model.merge.encode_ordinary(t)) == 1 for t in list(model.whole)[::500])


def plain_counts(text):
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    marked = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(marked)


def test_quality_rules_equal_brute_force(edge, empty, labels):
    trusted = labels.filter("quality = 1").select("doc_id")
    got = rows_of(quality_rules.judged(edge, trusted))
    assert len(got) == edge.count()
    texts = {r.doc_id: r.text for r in edge.collect() if r.doc_id is not None}
    for r in (r for r in got if r["doc_id"] is not None):
        counts = plain_counts(texts[r["doc_id"]] or "")
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == counts
        assert r["base_failed"] == (counts[0] < 10 or 100 * counts[4] > 20 * counts[0])
        assert r["kept"] == (not r["base_failed"] and r["llr"] >= quality_rules.MIN_LLR)
    kept = quality_rules.accepted(edge, trusted)
    assert kept.columns == edge.columns and kept.count() == sum(r["kept"] for r in got)
    assert quality_rules.judged(empty, trusted).count() == 0 and quality_rules.accepted(empty, trusted).count() == 0
    assert all(r["llr"] == 0 for r in rows_of(quality_rules.judged(edge, trusted.limit(0))))


def test_log_likelihood_ratio_equals_brute_force(spark):
    texts = {1: "good words in good order", 2: "good words again", 3: "$$$ &&& ***", 4: "good $$$"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r["doc_id"]: r["llr"] for r in rows_of(quality_rules.judged(docs, spark.createDataFrame([(1,), (2,)], "doc_id bigint")))}
    gram = lambda t: [((int.from_bytes(t.encode()[i : i + 3], "big") * 2654435761) % 2**32) >> 16 for i in range(len(t) - 2)]
    raw, target = Counter(), Counter()
    for i, t in texts.items():
        raw.update(gram(t))
        target.update(gram(t) if i < 3 else [])
    p = lambda c, g: math.log((c[g] + 1) / (c.total() + 65536))
    for i, t in texts.items():
        assert got[i] == pytest.approx(np.mean([p(target, g) - p(raw, g) for g in gram(t)]))


def test_trusted_ids_beyond_the_broadcast_bound_give_the_same(edge, labels):
    trusted = labels.filter("quality = 1").select("doc_id")
    assert rows_of(quality_rules.judged(edge, trusted, broadcast_rows=1)) == rows_of(quality_rules.judged(edge, trusted))


def test_factorisation_identity():
    rng = np.random.default_rng(1)
    f = quality_fm.Features([b"alpha beta beta gamma", b"", b"delta"], np.array([20.0, 0.0, 5.0]))
    m = quality_fm.Machine(f.dense, rng)
    m.w = rng.normal(size=m.w.shape).astype(np.float32)
    m.v = rng.normal(size=m.v.shape).astype(np.float32)
    got, _ = m.margins(f)
    z = m.scaled(f.dense)
    for i in range(3):
        at = slice(f.begin[i], f.begin[i + 1])
        ids = np.concatenate((f.index[at], np.arange(1 << quality_fm.BITS, len(m.w))))
        x = np.concatenate((f.value[at], z[i])).astype(np.float64)
        v, w = m.v[ids].astype(np.float64), m.w[ids].astype(np.float64)
        pairs = sum((v[a] @ v[b]) * x[a] * x[b] for a in range(len(ids)) for b in range(a))
        assert got[i] == pytest.approx(m.w0 + w @ x + pairs, rel=1e-3, abs=1e-3)


def test_classifier_scores_every_row(edge, empty, labels, spark):
    machine = quality_fm.train(edge, labels, common.held_out(4, 2))
    got = rows_of(quality_fm.scored(edge, machine))
    assert len(got) == edge.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert quality_fm.scored(empty, machine).count() == 0
    assert quality_fm.train(empty, labels, common.held_out(4, 2)) is None
    assert {r["score"] for r in rows_of(quality_fm.scored(edge, None))} == {0.5}


def test_classifier_learns_held_out_labels(spark, small):
    sf = small.replace("0.001", "0.01")
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    scored = quality_fm.scored(docs, quality_fm.train(docs, labels, common.held_out(4, 2))).join(labels, "doc_id").filter(common.held_out(4, 2))
    assert scored.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0] > 0.9


def test_held_out_is_crc32(edge):
    for r in edge.select("doc_id", common.held_out(4, 2).alias("h")).collect():
        assert r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def plain_base(text):
    assign = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def test_secret_findings_equal_brute_force(spark, edge, empty):
    path = common.fresh_path(spark, "ledger-test")
    got = rows_of(secret_ledger.findings(edge, path))
    assert len(got) == edge.count()
    texts = {r.doc_id: r.text for r in edge.collect() if r.doc_id is not None}
    for r in (r for r in got if r["doc_id"] is not None):
        assert r["base_spans"] == plain_base(texts[r["doc_id"]] or "")
    assert sum(r["n_assign"] for r in got) >= 1 and sum(r["n_access"] for r in got) == 1
    assert secret_ledger.findings(empty, common.fresh_path(spark, "ledger-test")).count() == 0


def test_ledger_scans_only_what_it_lacks(spark):
    path = common.fresh_path(spark, "ledger-test")
    first = spark.createDataFrame([(1, "a deadbeefdeadbeef"), (2, "b"), (3, "b")], "doc_id bigint, text string")
    secret_ledger.findings(first, path).collect()
    assert secret_ledger.ledger(spark, path).count() == 2
    second = first.union(spark.createDataFrame([(4, "c"), (5, "a deadbeefdeadbeef")], "doc_id bigint, text string"))
    got = rows_of(secret_ledger.findings(second, path))
    assert secret_ledger.ledger(spark, path).count() == 3 and [r["n_hex"] for r in got] == [1, 0, 0, 0, 1]
    secret_ledger.update_ledger(first, path, rule_version=2)
    assert secret_ledger.ledger(spark, path).groupBy("rule_version").count().count() == 2


def test_added_rules_and_redaction(spark, edge):
    text = "k ghp_" + "a1B2" * 10 + " and -----BEGIN RSA PRIVATE KEY----- end"
    kinds = [k for _, _, k in secret_ledger.find_secrets(text)]
    assert kinds == ["ghtoken", "pem"]
    assert secret_ledger.redact("ab secret cd", "x:3:9") == "ab [REDACTED x] cd" and secret_ledger.redact("0123456789", "a:1:5,b:3:7") == "0[REDACTED a]789"
    out = secret_ledger.redacted(edge, common.fresh_path(spark, "ledger-test"))
    assert out.columns == edge.columns and out.count() == edge.count()
    shown = {r.doc_id: r for r in out.collect()}
    assert "deadbeefdeadbeef" not in shown[12].text and shown[12].n_chars == len(shown[12].text) and shown[0].text is None
    assert all(plain_base(r.text or "") == "" for r in out.collect())


def test_unigram_equals_brute_force_and_every_text_is_scored(edge, empty, tokenizer):
    got = rows_of(attention_lm.scored(edge, ~common.held_out(5, 1), tokenizer))
    assert len(got) == edge.count()
    words = lambda t: [*WORD.findall((t or "").translate(LOWER)), "\0"]
    seen = Counter(w for r in edge.collect() if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 != 1 for w in words(r.text))
    texts = {r.doc_id: r.text for r in edge.collect() if r.doc_id is not None}
    for r in (r for r in got if r["doc_id"] is not None):
        own = words(texts[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(seen[w] > 0 for w in own), seen.total())
        assert r["base_score"] == pytest.approx(sum(math.log10((seen[w] + 0.5) / (seen.total() + 0.5 * (len(seen) + 1))) for w in own))
        assert math.isfinite(r["score"]) and r["score"] < 0
    assert attention_lm.scored(empty, ~common.held_out(5, 1), tokenizer).count() == 0


def test_rare_words_are_counted_by_the_join(edge, tokenizer, monkeypatch):
    whole = rows_of(attention_lm.scored(edge, ~common.held_out(5, 1), tokenizer))
    monkeypatch.setattr(attention_lm.frequent_words, "__defaults__", (3,))
    few = rows_of(attention_lm.scored(edge, ~common.held_out(5, 1), tokenizer))
    for a, b in zip(whole, few, strict=True):
        assert a["n_known"] == b["n_known"] and a["base_score"] == pytest.approx(b["base_score"])


def test_every_training_document_is_counted_and_trains_once(spark, tokenizer, monkeypatch):
    texts = [f"document {i} tells of thing{i * i}" for i in range(60)] + ["", "long " * 5000]
    docs = spark.createDataFrame([*enumerate(texts), (None, "without id")], "doc_id bigint, text string")
    met: list[list] = []
    monkeypatch.setattr(attention_lm, "train", lambda model, rows, windows: met.append([r[0] for r in rows.collect()]))
    counts = attention_lm.count_words(docs.select("text"))
    attention_lm.fit(docs, counts, docs.count(), tokenizer, "doc_id", "text")
    words, read = met[: attention_lm.ROUNDS], met[attention_lm.ROUNDS :]
    assert sorted(t for r in read for t in r) == sorted([*texts, "without id"])
    own = Counter(w for t in [*texts, "without id"] for w in t.encode().split())
    assert sorted(bytes(w) for r in words for w in r) == sorted(own) and {bytes(r.word): r.times for r in counts.collect()} == own


def plain_attention(model, inputs, targets):
    """log probability of each target by plain loops: all keys of the target's window up to its own input."""
    context, new = model.shape
    out = []
    for i, y in enumerate(targets):
        first = i // new * new - (context - new)
        weights, chosen = 0.0, 0.0
        for h in range(attention_lm.HEADS):
            for j in range(max(i - model.local + 1, 0) if h == 0 else max(first, 0), i + 1):
                w = math.exp(model.logits[h][inputs[i]][inputs[j]] + model.bias[h][i - j])
                weights, chosen = weights + w, chosen + w * model.values[h][inputs[j]][y]
        out.append(math.log(chosen / weights))
    return out


def test_score_is_that_of_a_plain_forward_over_whole_texts(spark, edge, tokenizer):
    A = attention_lm
    teach = edge.filter(~common.held_out(5, 1))
    counts = A.count_words(teach.select(F.coalesce("text", F.lit(""))))
    reader, text_model, word_model = A.fit(teach, counts, teach.count(), tokenizer, "doc_id", "text")
    times = {bytes(r.word): r.times for r in counts.collect()}
    encoder, spelled = A.bpe(tokenizer), {}

    def word_score(word):
        if word not in spelled:
            ids = encoder.encode_ordinary(" " + word.decode())
            inner = reader.inner.code[ids].tolist()
            log_p = sum(plain_attention(word_model, inner, [*inner[1:], A.END])) + reader.firsts.log_share[ids[0]] + sum(reader.inner.log_share[i] for i in ids[1:])
            s = reader.firsts.code[ids[0]]
            spelled[word] = int(s), math.log((1 - reader.unseen[s]) * times.get(word, 0) / max(reader.seen[s], 1) + reader.unseen[s] * math.exp(log_p)) if log_p > -600 else math.log(reader.unseen[s]) + log_p
        return spelled[word]

    got = {r.doc_id: r.score for r in A.scored(edge, ~common.held_out(5, 1), tokenizer).collect() if r.doc_id is not None}
    for r in edge.filter("doc_id is not null and length(coalesce(text, '')) < 3000").collect():
        words = [word_score(w) for w in (r.text or "").encode().lower().split()]
        codes = [s for s, _ in words] + [A.END]
        want = sum(plain_attention(text_model, [A.END, *codes[:-1]], codes)) + sum(v for _, v in words)
        assert got[r.doc_id] == pytest.approx(want / math.log(10), rel=1e-4)


def test_scores_do_not_depend_on_partitions(edge, tokenizer):
    runs = [sorted((str(r.doc_id), r.n_tokens, r.base_score, r.score) for r in attention_lm.scored(edge.repartition(n), ~common.held_out(5, 1), tokenizer).collect()) for n in (1, 5)]
    for a, b in zip(*runs, strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], rel=1e-12)


def test_attention_is_causal_and_proper_and_training_raises_the_likelihood():
    A = attention_lm
    rng = np.random.default_rng(0)
    model = A.Attention((8, 4), np.full(A.SYMBOLS, 1 / A.SYMBOLS))
    model.logits = rng.normal(0, 1, model.logits.shape)
    codes = rng.integers(1, 40, 60)
    codes[-1] = A.END
    one = lambda x: A.Windows(np.array(x), np.array([len(x)]), A.END, model.shape)
    base = model.ready().log_probs(one(codes)).ravel()[:60]
    changed = codes.copy()
    changed[40] = 77
    other = model.log_probs(one(changed)).ravel()[:60]
    assert np.allclose(base[:40], other[:40]) and base[40] == pytest.approx(other[40])  # values are still uniform
    both = A.Windows(np.concatenate((codes, codes)), np.array([60, 60]), A.END, model.shape)  # a text's score doesn't depend on its neighbours
    assert np.allclose(model.log_probs(both).sum(), 2 * base.sum())
    before = base.sum()
    for _ in range(4):
        model.update(model.ready().expected(one(codes)))
        after = model.ready().log_probs(one(codes)).sum()
        assert after > before
        before = after
    assert sum(np.exp(model.log_probs(one([*codes[:5], s])).ravel()[5]) for s in range(A.SYMBOLS)) == pytest.approx(1.0, abs=1e-4)
    assert model.log_probs(one(codes)).ravel()[:60] == pytest.approx(plain_attention(model, [A.END, *codes[:-1]], codes), rel=1e-4)
    split = [A.Windows(codes[a:b], np.array([b - a]), A.END, model.shape) for a, b in ((0, 20), (20, 60))]
    whole = A.Windows(codes, np.array([20, 40]), A.END, model.shape)
    assert (model.expected(split[1], model.expected(split[0])) == model.expected(whole)).all()


@pytest.mark.parametrize("shape", [attention_lm.TEXT_WINDOW, attention_lm.WORD_WINDOW])
def test_attention_looks_up_only_keys_that_a_target_attends_to(shape):
    looked = []

    class Counted(np.ndarray):
        def take(self, at, **how):
            looked.append(at.size)
            return np.asarray(self).take(at, **how)

    model = attention_lm.Attention(shape, np.full(attention_lm.SYMBOLS, 1 / attention_lm.SYMBOLS)).ready()
    model.weight = [w.view(Counted) for w in model.weight]
    context, new = shape
    for n in (new // 4, new // 2, new, new + new // 4, 5 * new):
        looked.clear()
        windows = attention_lm.Windows(np.arange(1, n + 1), np.array([n]), attention_lm.END, shape)
        assert model.log_probs(windows).shape == (-(-n // new), new)
        assert sum(looked) == sum(min(i + 1, model.local) + i - max(i // new * new - (context - new), 0) + 1 for i in range(n))


def test_words_met_again_are_remembered_and_numbers_tell_words_apart(tokenizer, monkeypatch):
    A = attention_lm
    size = A.bpe(tokenizer).max_token_value + 1
    codes = A.symbols(np.arange(size), np.arange(size), 1.0, A.bpe(tokenizer))
    table = A.WordTable(A.Reader(tokenizer, "test", codes, codes, np.ones(A.SYMBOLS), np.ones(A.SYMBOLS)))
    learned = []
    monkeypatch.setattr(A, "encoded", lambda encoder, words, real=A.encoded: learned.extend(words) or real(encoder, words))
    monkeypatch.setattr(A, "REMEMBERED", 50)
    for text, new in (
        (b"The common words", [b"common", b"the", b"words"]), (b"the COMMON words", []), (b" ".join(b"rare%d" % i for i in range(60)), [b"rare%d" % i for i in range(60)]),
        (b"words common to the\tother", [b"other", b"to"]), (b"rare7 the common", [b"rare7"]),
    ):
        learned.clear()
        table.windows([text])
        assert sorted(learned) == sorted(new)
    monkeypatch.setattr(A, "REMEMBERED", 100_000)
    words = [b"w%d" % (i * i % 40_009) for i in range(60_000)]
    _, numbers, n = table.windows([b" ".join(words[:50_000]), b"", b"\n".join(words[50_000:])])
    assert n.tolist() == [50_001, 1, 10_001] and (numbers == 0).nonzero()[0].tolist() == [50_000, 50_001, 60_002]
    own = numbers[numbers > 0].tolist()
    assert len(set(zip(own, words, strict=True))) == len(set(own)) == len(set(words))
    for word, number in list(dict(zip(words, own, strict=True)).items())[:200]:
        assert table.code[number] == codes.code[A.bpe(tokenizer).encode_ordinary(" " + word.decode())[0]]


def test_digest_of_no_secret_is_that_of_nothing():
    assert hashlib.sha256(plain_base("nothing here").encode()).hexdigest() == hashlib.sha256(b"").hexdigest()
