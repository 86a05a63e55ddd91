"""Near-duplicates, decontamination, mixing, archives, url templates and the pipeline against plain versions of themselves."""

import gzip
import hashlib
import random
import re
import tracemalloc
from collections import Counter
from fractions import Fraction

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folia.llm import common, components, decontaminate, minhash_dedup, mixing, quality_rules, queries, url_templates, warc_writer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_components(rows, k, percent):
    sets = {}
    for i, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()
    label = {i: i for i in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {i: new if v == old else v for i, v in label.items()}
    return {i: (len(sets[i]), label[i]) for i in ids}


def near_rows(seed=5, groups=6, size=14):
    """Groups of copies with rising numbers of edits, so that links form chains."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = []
    for g in range(groups):
        text = [word() for _ in range(90)]
        for n in range(size):
            if n % 5 != 4:
                text = list(text)
                text[rng.randrange(len(text))] = word()
            rows.append((g * 100 + n, " ".join(text)))
    return rows


def test_near_duplicates_equal_brute_force(spark, edge, empty):
    rows = near_rows() + [(9000 + r.doc_id, r.text) for r in edge.filter("doc_id is not null").select("doc_id", "text").distinct().collect()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for k, percent, bands in ((3, 85, 28), (5, 80, 36)):
        want = plain_components(rows, k, percent)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(docs, k=k, percent=percent, bands=bands, rows=5).collect()}
        assert got == want
    assert len({v[1] for v in want.values()}) < len(want)


def test_near_duplicates_on_edges(edge, empty):
    got = minhash_dedup.near_duplicates(edge).collect()
    assert len(got) == edge.count()
    by_id = {r.doc_id: r for r in got}
    assert by_id[6].component_id == by_id[7].component_id == by_id[8].component_id == 6 and not by_id[7].kept
    assert by_id[0].n_shingles == by_id[1].n_shingles == by_id[2].n_shingles == 0 and by_id[1].kept
    assert by_id[4].component_id == by_id[5].component_id == 4 and by_id[4].n_shingles == 1
    assert by_id[None].component_id is None and by_id[None].kept
    assert minhash_dedup.near_duplicates(empty).count() == 0 and minhash_dedup.deduplicated(empty).count() == 0
    kept = minhash_dedup.deduplicated(edge)
    assert kept.columns == edge.columns and 7 not in {r.doc_id for r in kept.collect()}


def test_families_of_several_blocks_and_beyond_the_broadcast_bound(spark, monkeypatch):
    rows = near_rows(seed=8, groups=2, size=40)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = plain_components(rows, 3, 85)
    monkeypatch.setattr(minhash_dedup, "BLOCK_DOCS", 7)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(docs, k=3, percent=85, bands=28, rows=5, broadcast_rows=1).collect()}
    assert got == want


def test_components_equal_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(500, 560)] + [(7, 7), (None, 3), (1000, 1001), (1001, 1000)] + [(2000, x) for x in range(2001, 2100)]
    label = {}
    find = lambda x: x if label.setdefault(x, x) == x else find(label[x])
    for a, b in ((a, b) for a, b in edges if a is not None and a != b):
        p, q = sorted((find(a), find(b)))
        label[q] = p
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in label}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


ITEMS = [
    (1, "Anna Smith buys 12 apples and 7 pears in the market of Berlin and pays 30 euros for everything together."),
    (2, "the quick brown fox jumps over the lazy dog while seventy geese fly home"),
    (3, "too short"),
    (None, "a question without any number that is long enough to be looked for"),
    (4, None),
]


def test_leaks_verbatim_and_reparameterised(spark, edge, empty):
    pad = " ".join(f"filler{i}" for i in range(60))
    verbatim = f"{pad}. {ITEMS[0][1]} {pad}"
    changed = f"{pad}. So Anna Smith buys".replace("So ", "") + ITEMS[0][1].removeprefix("Anna Smith buys").replace("12", "15").replace("7", "9").replace("30", "44").replace("Berlin", "Paris") + f" {pad}"
    inconsistent = f"{pad}. " + ITEMS[0][1].replace("12", "5").replace(" 7 ", " 5 ").replace("30", "5") + f" {pad}"
    half = f"{pad} the quick brown fox jumps over the lazy {pad}"
    case = f"{pad} THE QUICK BROWN fox, jumps over the lazy dog while seventy geese fly home {pad}"
    docs = spark.createDataFrame([(1, verbatim), (2, changed), (3, half), (4, case), (5, pad), (6, None), (7, ""), (8, inconsistent)], "doc_id bigint, text string")
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(docs, bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (4, 2)}
    assert got[1, 1].same_values and not got[2, 1].same_values
    shuffled = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(docs, bench, broadcast_rows=1).collect()}
    assert shuffled == got
    clean = decontaminate.decontaminated(docs.withColumn("hash", F.lit(1)), bench)
    assert clean.columns == ["doc_id", "text", "hash"] and {r.doc_id for r in clean.collect()} == {3, 5, 6, 7, 8}
    assert decontaminate.leaks(empty, bench).count() == 0 and decontaminate.leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.decontaminated(edge, bench).count() == edge.count()


def test_attached_units_number_words_and_names_at_a_sentence_start(spark):
    pairs = [
        ("the shop sells the coat for $200 and takes 15% off on days when 5kg of wool came in", "the shop sells the coat for €350 and takes 20% off on days when 7kg of wool came in"),
        ("there were nineteen boys and twenty-five girls who sang together while sixty old men slept", "there were fourteen boys and thirty-one girls who sang together while ninety old men slept"),
        ("Alice has 12 apples. Alice gives Bob 5. Alice eats 2. Alice then sells all the rest today.", "Maria has 15 apples. Maria gives Tom 7. Maria eats 3. Maria then sells all the rest today."),
    ]
    bench = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(pairs)], "item_id bigint, text string")
    docs = spark.createDataFrame([(i, f"so it is. {b} and so on") for i, (_, b) in enumerate(pairs)] + [(10 + i, f"so it is. {a} and so on") for i, (a, _) in enumerate(pairs)], "doc_id bigint, text string")
    for rows in (1000, 0):
        got = {(r.doc_id, r.item_id, r.same_values) for r in decontaminate.leaks(docs, bench, broadcast_rows=rows).collect()}
        assert got == {(i, i, False) for i in range(3)} | {(10 + i, i, True) for i in range(3)}


def test_copies_of_short_and_unspecific_items_are_found(spark):
    items = ["Who wrote Pride and Prejudice?", "3 4 5 12 30 42 7 8 15", "Paris London Berlin Rome Madrid Vienna Oslo Bern Prague Dublin", "too short"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    texts = [f"so it was. {i} and more" for i in items] + ["Who wrote Emma and Prejudice?", "3 4 5 12 30 42 7 8 16", "Paris London Berlin Rome Madrid Vienna Oslo Bern Prague x Prague Dublin", "too very short"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for rows in (1000, 0):
        assert {(r.doc_id, r.item_id, r.same_values) for r in decontaminate.leaks(docs, bench, broadcast_rows=rows).collect()} == {(i, i, True) for i in range(4)}


def test_windows_are_judged_not_whole_runs():
    run = [(100 + at, at, [value], ["12"]) for at, value in enumerate(["12"] * 20 + ["13"] * 8)]
    assert decontaminate.consistent_cover(run) == (20, True)
    merged = [(100 + at, at, ["5"], [given]) for at, given in enumerate(["3"] * 4 + ["4"] * 4)]
    assert decontaminate.consistent_cover(merged) == (8, False)
    chance = [(100 + at, at, ["5"], [given]) for at, given in enumerate("34678")]
    assert decontaminate.consistent_cover(chance) == (1, False)


def test_repeated_and_null_ids_are_judged_row_by_row_on_both_paths(spark):
    item = ITEMS[0][1].split()
    parts = [" ".join(item[:10]), " ".join(item[5:15]), " ".join(item[10:])]
    rows = [(i, p) for i in (1, None) for p in parts] + [(2, ITEMS[0][1])] * 2 + [(None, ITEMS[0][1])] * 2
    docs, bench = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), spark.createDataFrame(ITEMS, "item_id bigint, text string")
    for most in (1000, 1):
        got = [(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench, broadcast_rows=most).collect()]
        assert Counter(got) == {(2, 1): 2, (None, 1): 2}


def test_benchmark_passages_are_found_and_only_they(spark, small):
    docs, bench = common.table(spark, small, "documents"), common.table(spark, small, "benchmark")
    items = {r.item_id: " ".join(r.text.lower().split()) for r in bench.collect()}
    want = {(d.doc_id, i) for d in docs.collect() for i, t in items.items() if t in " ".join((d.text or "").lower().split())}
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()} == want


@pytest.mark.parametrize("tickets", [{"a": 1}, {"a": 5, "b": 3, "c": 2}, {"a": 1, "b": 1, "c": 1}, {"a": 97, "b": 2, "c": 1}, {c: n for n, c in enumerate("abcdefghij", start=1)}])
def test_schedule_keeps_within_a_block_of_every_target(tickets):
    total = sum(tickets.values())
    slots = mixing.period(tickets)
    assert sorted(s for v in slots.values() for s in v) == list(range(total))
    for name, t in tickets.items():
        share = Fraction(t, total)
        for now in range(total + 1):
            done = sum(s < now for s in slots[name])
            assert abs(done - share * now) < 1
        for j, s in enumerate(slots[name]):
            assert j * total // t <= s < -(-(j + 1) * total // t)


def test_mix_is_whole_and_follows_the_targets(spark, edge, empty):
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, rng.choice("aaaaabbc")) for i in range(2000)], "doc_id bigint, source string")
    tickets = {"a": 2, "b": 2, "c": 1}
    got = mixing.mixed(docs, tickets, block_docs=4).collect()
    assert sorted(r.doc_id for r in got) == list(range(2000)) and len({r.place for r in got}) == 2000
    block = {(r.source, r.block): r.slot for r in got}
    assert len(set(block.values())) == len(block) and sorted(block.values()) == list(range(len(block)))
    sizes = Counter(s for s, _ in block)
    order = sorted(block, key=block.get)
    left, weights = dict(sizes), dict(tickets)
    start, done = 0, Counter()
    for t, (s, _) in enumerate(order, start=1):  # in each phase every prefix is within one block
        done[s] += 1
        left[s] -= 1
        for x in weights:
            assert abs(done[x] - Fraction(weights[x], sum(weights.values())) * (t - start)) < 1
        if not left[s]:
            del weights[s]
            start, done = t, Counter()
    assert [tuple(r) for r in sorted(mixing.mixed(docs.repartition(5), tickets, block_docs=4).collect())] == [tuple(r) for r in sorted(got)]
    assert mixing.mixed(edge).count() == edge.count() and mixing.mixed(empty).count() == 0


def page_rows():
    body = "<p>" + "x" * 200 + "</p>"
    return [(1, "http://a/1", body), (2, "http://a/2", body), (3, "http://a/3", "short"), (4, "http://a/4", "short"), (5, None, None), (6, "http://a\r\nX: 1", "é" * 60), (7, "u", "é" * 60), (None, "n", body), (8, "http://a/8", "y" * 5000), (8, "http://a/8b", body), (9, "z", ""), (9, "z", "")]


def test_archives_round_trip(spark):
    pages = spark.createDataFrame(page_rows(), "page_id bigint, url string, html string")
    folder = common.fresh_path(spark, "warc-test")
    manifest = warc_writer.write(pages.withColumn("digest", F.lit("clash")), folder)
    got = warc_writer.read(manifest, folder).collect()
    assert len(got) == len(page_rows()) and all(r.payload_ok for r in got)
    want = Counter()
    least = {}
    for i, _, h in page_rows():
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            least[b] = min(i, least.get(b, i))
    for i, _, h in page_rows():
        b = (h or "").encode()
        to = least.get(b) if i is not None and b in least and i > least[b] else None
        want[(i, len(b), hashlib.sha256(b).hexdigest(), "response" if to is None else "revisit", to)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    again = common.fresh_path(spark, "warc-test")
    other = warc_writer.write(pages.repartition(7), again)
    assert sorted((r.file, r.sha256) for r in manifest.collect()) == sorted((r.file, r.sha256) for r in other.collect())
    ids = []
    for r in manifest.collect():
        raw = open(f"{folder.removeprefix('file:')}/{r.file}", "rb").read()
        assert gzip.decompress(raw).count(b"WARC/1.1\r\n") == r.records + 1 and hashlib.sha256(raw).hexdigest() == r.sha256
        ids += re.findall(rb"WARC-Record-ID: (.*)\r\n", gzip.decompress(raw))
    assert len(ids) == len(set(ids))


def test_archives_roll_and_empty_tables(spark):
    rng = random.Random(1)
    rows = [(i, f"u{i}", "".join(chr(rng.randrange(33, 127)) for _ in range(3000))) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    folder = common.fresh_path(spark, "warc-test")
    manifest = warc_writer.write(pages, folder, shard_ids=16, roll_bytes=8000)
    assert manifest.count() > 6 and warc_writer.read(manifest, folder).count() == 40
    none = common.fresh_path(spark, "warc-test")
    assert warc_writer.read(warc_writer.write(pages.limit(0), none), none).count() == 0


def test_hosts_paths_and_rules(spark):
    urls = ["HTTP://WWW.Example.COM/en/1?x", "x://example.com/en/", "a://b.example.com/EN/1", "a://notexample.com/en/1", "a://q.net/es/1", "a://net/fr/1", "a://net", "no scheme", None, "a://h?x=/en/", "a://h#f", "a://ÄB.com/x://y", "a://com:80/x"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {r.page_id: r for r in url_templates.verdicts(rows, queries.URL_RULES, None, None).collect()}

    def parts(u):
        if u is None or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        return host.translate(LOWER), re.match(r"[^?#]*", rest[len(host) :])[0]

    for i, u in enumerate(urls):
        host, path = parts(u)
        fits = [r for r in queries.URL_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        rule = max(fits, key=len, default=None)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == (queries.URL_RULES[rule] if rule else "allow")


def test_bad_templates_are_rejected_and_others_not(spark):
    rows = [(i, f"http://h/{'spam' if i % 2 else 'news'}/{i}", i % 2 if i < 200 else None) for i in range(400)]
    rows += [(1000 + i, f"http://g/a{i}/x", 0) for i in range(30)] + [(2000, "http://h/spam/77/deep/er/and/deeper/still/more", None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, bad int")
    labels = pages.filter("bad is not null").select(F.col("page_id").alias("label_key"), "bad")
    got = {r.page_id: r for r in url_templates.verdicts(pages, {}, labels, F.col("page_id")).collect()}
    assert len(got) == len(rows)
    assert {got[i].verdict for i in range(1, 400, 2)} == {"block"} and {got[i].verdict for i in range(0, 400, 2)} == {"allow"}
    assert got[1].template == "/spam/<n>" and {got[1000 + i].template for i in range(30)} == {"/*/x"}
    assert url_templates.verdicts(pages.limit(0), {}, labels, F.col("page_id")).count() == 0
    assert url_templates.verdicts(pages, {}, labels.limit(0), F.col("page_id")).filter("verdict = 'block'").count() == 0
    plan = url_templates.verdicts(pages, queries.URL_RULES, labels, F.col("page_id"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_bad_section_is_kept_apart_at_any_fan_out(spark):
    for sections in (10, 40):
        rows = [(s * 1000 + i, f"http://h/s{chr(97 + s % 26)}{chr(97 + s // 26)}/{i}", 0) for s in range(sections) for i in range(50)]
        rows += [(900_000 + i, f"http://h/spam/{i}", 1) for i in range(200)] + [(990_000, "http://h/once/1", 1)]
        pages = spark.createDataFrame(rows, "page_id bigint, url string, bad int")
        got = {r.page_id: r for r in url_templates.verdicts(pages, {}, pages.select(F.col("page_id").alias("label_key"), "bad"), F.col("page_id")).collect()}
        assert {(got[i].template, got[i].verdict) for i in range(900_000, 900_200)} == {("/spam/<n>", "block")}
        assert {got[s * 1000].verdict for s in range(sections)} == {"allow"}
    assert got[990_000].template == "/*/<n>"


def test_branches_are_told_apart_at_any_depth(spark):
    deep = "/a/b/c/d/e/f/g/h"
    rows = [(i, f"http://h{deep}/{'ads' if i % 2 else 'story'}/x/{i}", i % 2) for i in range(200)] + [(500, "http://g" + "/only" * 300, None), (501, "http://h" + deep, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, bad int")
    labels = pages.filter("bad is not null").select(F.col("page_id").alias("label_key"), "bad")
    got = {r.page_id: r for r in url_templates.verdicts(pages, {}, labels, F.col("page_id")).collect()}
    assert {(got[i].template, got[i].verdict) for i in range(200)} == {(f"{deep}/ads/x/<n>", "block"), (f"{deep}/story/x/<n>", "allow")}
    assert got[500].template == "/only" * 300 and got[501].template == deep and len(got) == len(rows)


@pytest.fixture(scope="module")
def staged(spark, small):
    docs, out = common.table(spark, small, "documents"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, small), f"test-{name}")
        out[name] = docs
    return out


def test_workers_of_the_pipeline_hold_little_and_chunks_do_not_change_results(spark, monkeypatch):
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(10**9)}" if n % 2 else rng.choice("abcdefgh") * 9 for n in range(300)) for _ in range(1000)]
    texts[::50] = [f"{t} {ITEMS[0][1]}" for t in texts[::50]]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1000)), "text": texts})
    docs, bench = spark.createDataFrame([(1, "a few words")], "doc_id bigint, text string"), spark.createDataFrame(ITEMS, "item_id bigint, text string")
    runs, real = [], common.map_batches
    monkeypatch.setattr(common, "map_batches", lambda df, run, schema: runs.append(run) or real(df, run, schema))
    decontaminate.leaks(docs, bench)
    minhash_dedup.signed(docs, 5, 36, 5, "doc_id", "text")
    quality_rules.accepted(docs, docs.select("doc_id"))
    trusted = pa.RecordBatch.from_arrays([batch.column(1), pa.array([True] * 1000)], names=["text", "trusted"])
    for run, given, most in zip(runs[1:], (batch, batch, trusted, batch), (75e6, 30e6, 25e6, 35e6), strict=True):
        tracemalloc.start()
        got = pa.Table.from_batches(run(iter([given])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert got.num_rows and peak < most
        for size in (20_000, 2_000_000):
            with monkeypatch.context() as patch:
                patch.setattr(common, "FINE_BYTES", size)
                assert pa.Table.from_batches(run(iter([given]))).equals(got)


def test_pipeline_stages_take_effect(spark, small, staged):
    columns = staged["documents"].columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    for name in names[:-1]:
        assert staged[name].columns == columns
    counts = [staged[n].count() for n in ("documents", *names)]
    assert counts == sorted(counts, reverse=True) and counts[0] > counts[1] > counts[2] > counts[3] == counts[4] == counts[5]
    rows = [(r.doc_id, r.text) for r in staged["quality"].collect()]
    label = plain_components(rows, 5, 80)
    assert {r.doc_id for r in staged["near_duplicates"].collect()} == {i for i, (_, c) in label.items() if i == c}
    assert decontaminate.leaks(staged["decontamination"], common.table(spark, small, "benchmark")).count() == 0
    good = {r.doc_id for r in common.table(spark, small, "labels").filter("quality = 1").collect()}
    lost = good & ({r.doc_id for r in staged["documents"].collect()} - {r.doc_id for r in staged["quality"].collect()})
    texts = {r.doc_id: r.text or "" for r in staged["documents"].collect()}

    def failed(t):  # by the fixed rules
        w = WORD.findall(t)
        seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        marked = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        return len(w) < 10 or 100 * len(marked) > 20 * len(w)

    assert all(failed(texts[i]) for i in lost)
    assert {r.doc_id for r in staged["mixing"].collect()} == {r.doc_id for r in staged["secrets"].collect()}


def test_pipeline_runs_on_edges(spark, small, edge, empty):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (edge.select(*names), empty.select(*names), edge):
        now = docs
        for name, stage in corpus_pipeline.STAGES:
            now = common.stored(stage(spark, now, small), f"edge-{name}")
        now.count()


def test_entry_lists_all_queries():
    import __spark_entry__ as entry

    have = entry.queries()
    assert {re.match(r"op\d+_", n)[0] for n in have if re.match(r"op\d+_", n)} == {f"op{n}_" for n in range(1, 11)} and "pipeline" in have
    assert set(entry.oracle_sql()) <= set(have)
