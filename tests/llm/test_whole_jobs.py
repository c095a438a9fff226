"""Cases that an operator once did less than whole."""

import hashlib
import random
from collections import Counter

import corpus_pipeline
from fleetsight.llm import decontaminate, near_copies, quality, substring_dedup


def brute_set(text, size=5):
    words = (text or "").lower().split()
    return frozenset(tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))) if words else frozenset()


def test_near_copies_stage_drops_what_is_four_fifths_alike(spark):
    rnd = random.Random(21)
    line = lambda n: [f"w{rnd.randrange(10_000)}" for _ in range(n)]
    rows = []
    for family in range(25):
        base = line(rnd.randint(30, 300))
        for member in range(8):
            words = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 30))):
                words[rnd.randrange(len(words))] = f"v{rnd.randrange(10_000)}"
            rows.append((100 * family + member, " ".join(words)))
    rows += [(9000, "one two three"), (9001, "One  two\nthree"), (9002, "one two"), (9003, ""), (9004, None), (9005, " \n")]
    sets = {number: brute_set(text) for number, text in rows}
    parent = {number: number for number in sets}

    def root(number):
        while parent[number] != number:
            number = parent[number]
        return number

    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in near_copies.components(docs).collect()}
    assert got == {number: root(number) for number in sets}
    kept = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert kept == sorted({root(number) for number in sets}) and len(kept) < 0.7 * len(rows)


def test_an_item_without_its_first_letters_is_found_in_the_text_that_holds_it():
    item = "which of these words stands first in the list that the teacher wrote on the board this morning"
    index = decontaminate.Index(decontaminate.segments([(1, item)]))
    for missing in (1, 2, 3, 4, 6, 7):  # a blank at the start would go too
        for clean in ("a clean text", "a clean text that ends in " + item[:missing], "x" * 200, ""):
            got = list(decontaminate.find([clean, item[missing:] + " and more", clean], index))
            assert [row[:3] for row in got] == [(1, 1, missing)] and got[0][3] == 0


def test_a_verbatim_quote_of_a_part_is_found_wherever_it_lies(spark):
    rnd = random.Random(6)
    line = lambda n: " ".join("".join(rnd.choices("etaoinshr", k=rnd.randint(2, 8))) for _ in range(n))
    sure = 75
    items = [(k, line(80)[:size].strip() + "z") for k, size in enumerate((76, 100, 150, 159, 161, 230, 400))]
    quotes = [(item, text[at : at + sure]) for item, text in items for at in range(0, len(text) - sure + 1)]
    quotes = [(item, quote) for item, quote in quotes if quote == quote.strip()]
    docs = [(k, f"{line(6)} {quote} {line(6)}") for k, (_, quote) in enumerate(quotes)] + [(-1, line(300))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(k, item) for k, (item, _) in enumerate(quotes)]
    assert all(r.edits == 0 for r in found)


def test_the_sample_is_bounded_with_null_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE", 200)
    sizes, fit = [], quality.fit_scorer
    monkeypatch.setattr(quality, "fit_scorer", lambda present, *rest: sizes.append(len(present)) or fit(present, *rest))
    rnd = random.Random(3)
    line = lambda: " ".join(rnd.choice(["plain", "words", "of", "a", "text", "zzz", "!!!", "one", "two"]) for _ in range(30))
    same = line()
    rows = [(None, line()) for _ in range(1500)] + [(7, line()) for _ in range(1500)] + [(8, same)] * 1500 + [(100 + k, line()) for k in range(1500)]
    labels = [(7, 1, 0), (8, 0, 1), *[(100 + k, k % 2, 0) for k in range(300)]]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert quality.classify(docs, labels).count() == len(rows)
    assert sizes and all(140 <= size <= 260 for size in sizes)


def test_batches_are_bounded_with_an_outlier_and_with_hot_ids(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BATCH_WORDS", 800)
    monkeypatch.setattr(substring_dedup, "BUCKET_WORDS", 500)
    rnd = random.Random(12)
    line = lambda n: " ".join(f"w{rnd.randrange(1000, 9999)}" for _ in range(n))
    passage, same = line(30), line(25)
    body = lambda: line(20) + (" " + passage if rnd.random() < 0.3 else "") + " " + line(5)
    rows = [(k, body()) for k in range(200)] + [(10**15, body()), (-(10**15), body())]
    rows += [(None, body()) for _ in range(200)] + [(77, body()) for _ in range(200)] + [(78, same)] * 200 + [(79, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    layout = substring_dedup.Layout(docs, "doc_id", "text")
    sizes = Counter()
    for r in docs.withColumn("batch", layout.batch("doc_id", "text")).collect():
        sizes[r.batch] += len((r.text or "").split())
    assert max(sizes.values()) < 3 * max(800, (64 * sum(sizes.values())) ** 0.5) < sum(sizes.values()) / 4
    seen, want = set(), Counter()
    for number, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        words = (text or "").split()
        gone = [False] * len(words)
        for k in range(len(words) - 19):
            window = tuple(words[k : k + 20])
            if window in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(window)
        kept = " ".join(word for word, out in zip(words, gone) if not out)
        want[(number, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    assert Counter(map(tuple, substring_dedup.remove_repeats(docs).collect())) == want


def test_pages_of_one_template_lose_no_link(spark):
    """150 pairs, over 0.8 alike within a pair and under it across: all in the same large buckets."""
    rnd = random.Random(31)
    line = lambda n: [f"w{rnd.randrange(100_000)}" for _ in range(n)]
    template, rows = line(504), []
    for pair in range(150):
        own = line(58)
        for member in range(2):
            rows.append((2 * pair + member, " ".join(template + own + line(6))))
    sets = [brute_set(text) for _, text in rows]
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert alike(0, 1) >= 0.8 > alike(0, 2) > 0.77
    # A group of copies among them, large and near, one of its members by a second step only.
    copies = template + line(300)
    rows += [(1000 + k, " ".join(copies[: 790 + k % 9] + line(2))) for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in near_copies.components(docs).collect()}
    assert all(got[2 * pair] == got[2 * pair + 1] == 2 * pair for pair in range(150))
    assert {got[1000 + k] for k in range(90)} == {1000}
    kept = sorted(r.doc_id for r in near_copies.keep_one(docs).collect())
    assert kept == [2 * pair for pair in range(150)] + [1000]


def test_prefix_pairs_hold_every_pair_that_is_alike(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    base, rows = rng.integers(0, 1 << 40, 60), []
    for bits in range(30):
        keep = rng.random(60) < rng.choice([0.85, 0.95, 1.0])
        rows.append((bits, bits % 20, np.unique(np.concatenate([base[keep], rng.integers(0, 1 << 40, rng.integers(0, 12))]))))
    sets = spark.createDataFrame([(b, p, bytearray(found.astype("<i8").tobytes())) for b, p, found in rows], "bits long, part long, body binary")
    got = {(r.a, r.b) for r in near_copies.prefix_pairs(sets).collect()}
    for a, part, one in rows:
        for b, other_part, other in rows[a + 1 :]:
            both = np.intersect1d(one, other).size
            if part != other_part and both / (one.size + other.size - both) >= 0.8:
                assert (a, b) in got
    assert all(a < b and rows[a][1] != rows[b][1] for a, b in got)


def test_pairs_of_a_large_group_grow_with_its_members(spark):
    import numpy as np

    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 40, 200)
    rows = [(bits, bits, bytearray(np.unique(np.concatenate([base[rng.random(200) < 0.9], rng.integers(0, 1 << 40, 4)])).astype("<i8").tobytes())) for bits in range(600)]
    sets = spark.createDataFrame(rows, "bits long, part long, body binary")
    assert near_copies.prefix_pairs(sets).count() < 40 * len(rows)


def test_no_link_of_a_large_group_is_lost(spark):
    """Sets around one base, whose shared shingles are frequent, each in a part of its own or a few large parts."""
    import numpy as np

    rng = np.random.default_rng(11)
    base, rows = rng.integers(0, 1 << 40, 120), []
    for bits in range(300):
        kept = base[rng.random(120) < rng.choice([0.84, 0.9, 0.97])]
        rows.append((bits, bits % 7 if bits % 3 else bits, np.unique(np.concatenate([kept, rng.integers(0, 1 << 40, rng.integers(0, 9))]))))
    sets = spark.createDataFrame([(b, p, bytearray(found.astype("<i8").tobytes())) for b, p, found in rows], "bits long, part long, body binary")
    rare = near_copies.rare_shingles(sets)
    alike = set()
    for a, part, one in rows:
        for b, other_part, other in rows[a + 1 :]:
            both = np.intersect1d(one, other).size
            if part != other_part and both / (one.size + other.size - both) >= 0.8:
                alike.add((a, b))
    got = [(r.a, r.b) for r in near_copies.remaining_pairs(rare).collect()]
    assert len(alike) > 1000 and alike <= set(got) and len(got) == len(set(got))
    assert all(a < b and rows[a][1] != rows[b][1] for a, b in got)
    assert not alike <= {(r.a, r.b) for r in near_copies.first_pairs(rare).collect()}
    # The same where a shingle's members are dealt over several blocks.
    before, near_copies.BLOCK = near_copies.BLOCK, 20
    try:
        assert {(r.a, r.b) for r in near_copies.remaining_pairs(rare).collect()} == set(got)
    finally:
        near_copies.BLOCK = before


def test_components_of_a_page_family_equal_brute_force(spark):
    """Pages of one stem with sections left out: links run through members that no star stands for."""
    rnd = random.Random(29)
    sections = [" ".join("".join(rnd.choices("etaoinshr", k=6)) for _ in range(14)) for _ in range(24)]
    texts = sorted({" ".join(s for s in sections if rnd.random() > 0.16) for _ in range(160)})
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)

    def shingles(text):
        words = text.split()
        return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}

    sets, root = [shingles(text) for text in texts], list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    got = {r.doc_id: r.component_id for r in near_copies.components(docs).collect()}
    assert got == {k: find(k) for k in range(len(texts))}
    assert 1 < len(set(got.values())) < len(texts)


def test_a_line_that_many_items_share_and_a_text_repeats(spark):
    """Items begin with one line; texts hold it once, often, changed, or beside an item of its own."""
    rnd = random.Random(41)
    word = lambda: "".join(rnd.choices("etaoinshr", k=6))
    line = "answer the following question and choose the one best option that is given below"
    items = [(k, line + " " + " ".join(word() for _ in range(12))) for k in range(60)]
    near = line.replace("best", "bost")
    docs = [(1, " ".join([line] * 120)), (2, " ".join([near] * 120)), (3, " ".join(word() for _ in range(80))), (4, "start " + items[7][1] + " end " + line), (5, None)]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, text string")
    found = decontaminate.contaminated(frame(docs, "doc_id"), frame(items, "item_id")).collect()
    got = {(r.doc_id, r.item_id): (r.edits, r.start_char) for r in found}
    assert all(got[1, k] == (0, 0) and got[2, k][0] == 1 for k in range(60))
    assert all(got[4, k][0] == 0 for k in range(60)) and got[4, 7][1] == 6
    assert {doc for doc, _ in got} == {1, 2, 4}


def test_several_blocks_of_the_benchmark_give_what_one_gives(spark, monkeypatch):
    rnd = random.Random(43)
    words = lambda n: " ".join("".join(rnd.choices("etaoinshr", k=5)) for _ in range(n))
    items = [(k, words(40)) for k in range(30)]
    docs = [(k, words(20) + " " + items[k][1][30:150] + " " + words(20)) for k in range(0, 30, 3)] + [(100, words(60)), (101, "")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string")
    whole = sorted(tuple(r) for r in decontaminate.contaminated(table, benchmark).collect())
    kept = sorted(r.doc_id for r in decontaminate.drop_contaminated(table, benchmark).collect())
    monkeypatch.setattr(decontaminate, "SEGMENTS_AT_ONCE", 100)
    assert sorted(tuple(r) for r in decontaminate.contaminated(table, benchmark).collect()) == whole
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(table, benchmark).collect()) == kept == [100, 101]
    assert [row[:2] for row in whole] == [(k, k) for k in range(0, 30, 3)]
    assert decontaminate.contaminated(table.limit(0), benchmark).count() == 0


def test_the_stage_pairs_by_the_fingerprint_index_too(spark):
    """Without a band of MinHash, groups of the Gray-order index link what is alike; the exact likeness decides."""
    import numpy as np
    from pyspark.sql import functions as F

    from fleetsight.llm import simhash

    rnd = random.Random(47)
    line = lambda n: [f"w{rnd.randrange(10_000)}" for _ in range(n)]
    rows = []
    for family in range(30):
        base = line(400)
        rows += [(10 * family + member, " ".join(base + line(member))) for member in range(4)]
    rows += [(900 + family, " ".join(["same"] * 300 + line(4))) for family in range(20)] + [(990, ""), (991, None), (992, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = {number: brute_set(text) for number, text in rows}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) or sets[a] == sets[b]
    whole, marked = near_copies._marked(docs, 5)
    codes = {r.doc_id: r.code & (2**64 - 1) for r in marked.collect()}
    parent = {number: number for number in sets}

    def root(number):
        while parent[number] != number:
            number = parent[number]
        return number

    for a in sets:
        for b in sets:
            if a < b and alike(a, b) and (codes[a] ^ codes[b]).bit_count() <= near_copies.NEAR:
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    bare = marked.withColumn("bands", F.expr("filter(bands, band -> false)"))
    classes, roots = near_copies._rooted(whole, bare, 5, 0.8)
    least = simhash.least_ids(classes.select("bits", F.col("first.doc_id").alias("least_id")), roots)
    got = {r.doc_id: r.component_id for r in marked.join(least, "bits").collect()}
    assert got == {number: root(number) for number in sets}
    assert len(set(got.values())) < len(sets) - 60
    assert near_copies.keep_one(docs).count() == 30 + len({root(number) for number in sets if number >= 900})

    hashes = np.random.default_rng(3).integers(0, 1 << 63, 12, dtype=np.uint64)
    found = simhash.set_fingerprints(hashes, np.array([0, 0, 5, 5, 12, 12]))
    majority = lambda part: sum(1 << bit for bit in range(64) if 2 * sum(int(h) >> bit & 1 for h in part) > len(part))
    assert found.tolist() == [majority(hashes[a:b]) for a, b in ((0, 0), (0, 5), (5, 5), (5, 12), (12, 12))]


def test_the_index_finds_all_links_at_other_distances(spark):
    import numpy as np

    from fleetsight.llm import simhash

    rng = np.random.default_rng(11)
    codes = set()
    for base in rng.integers(0, 1 << 63, 40).tolist():
        for _ in range(12):
            codes.add(base ^ sum({1 << int(bit) for bit in rng.integers(0, 63, rng.integers(0, 5))}))
    frame = spark.createDataFrame([(code,) for code in codes], "bits long")
    for distance in (2, 3):
        got = {tuple(sorted((r.a, r.b))) for r in simhash.links(frame, distance).collect()}
        assert got == {(a, b) for a in codes for b in codes if a < b and (a ^ b).bit_count() <= distance}
        trees = simhash.links(frame, distance, trees=True)
        roots = lambda edges: sorted(tuple(r) for r in simhash.star_roots(edges).collect())
        assert roots(trees) == roots(simhash.links(frame, distance)) and trees.count() <= (distance + 1) * len(codes)


def test_trees_join_what_pairs_of_several_parts_join():
    import numpy as np

    from fleetsight.llm import simhash

    rng = np.random.default_rng(5)
    for _ in range(50):
        a, b = np.sort(rng.integers(0, 60, (2, 45)), axis=0)
        least = np.arange(60)
        for _ in range(60):
            np.minimum.at(least, a, least[b]), np.minimum.at(least, b, least[a])
        cuts = [0, 9, 9, 30, 45]
        places, first = simhash.forest(((a[i:k], b[i:k]) for i, k in zip(cuts, cuts[1:])), 60)
        assert places.tolist() == np.flatnonzero(least < np.arange(60)).tolist() and first.tolist() == least[places].tolist()
