"""The operators against brute force, the tokenizers library and exact round trips on small tables."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from fleetsight.llm import bpe, chat, decontaminate, lm_scoring, simhash, spotsigs, substring_dedup, url_filter, warc
from fleetsight.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, batch long, value string"
BLANK = re.compile("[\x20\x09-\x0d]+")


def words_of(text):
    return [word for word in BLANK.split(text or "") if word]


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, shared passages, repeats within a text, blanks, nulls, a long text and a repeated row."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice(["the", "ing", "er", "tion", "é", "ö", "x"]) for _ in range(rnd.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(30)
    rows = [(i, text(rnd.randint(1, 60)), "en", i, "v") for i in range(0, 60)]
    rows += [(100 + i, text(rnd.randint(0, 30)) + "\n" + passage + "\t" + text(5), None, None, None) for i in range(12)]
    rows += [(200 + i, rows[3][1], "fr", 1, None) for i in range(8)]
    rows += [(300, passage + " " + passage + " " + passage, "en", 1, "v"), (301, "a " * 200, "en", 1, "v")]
    rows += [(302, "", "en", 1, "v"), (303, None, "en", 1, "v"), (304, " \n\t ", "en", 1, "v"), (305, "\x1c A\x85b", "en", 1, "v")]
    rows += [(306, text(20_000), "en", 1, "v"), (307, "x" * 30_000, "en", 1, "v"), rows[5], (5, "another text of that id", "en", 1, "v")]
    rows += [(None, passage, "en", 1, "v"), (-7, text(40), "en", 1, "v")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


def test_substring_dedup_equals_brute_force(docs, rows):
    seen, want = set(), Counter()
    for number, text in sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        words = words_of(text)
        gone = [False] * len(words)
        for at in range(len(words) - 19):
            window = tuple(words[at : at + 20])
            if window in seen:
                gone[at : at + 20] = [True] * 20
            seen.add(window)
        kept = " ".join(word for word, out in zip(words, gone) if not out)
        want[(number, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    got = Counter(map(tuple, substring_dedup.remove_repeats(docs).collect()))
    assert got == want
    assert sum(key[2] for key in want) > 300


def brute_fingerprint(text):
    words = words_of("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(shingle.encode(), 42) for shingle in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute_components(ids_and_codes):
    codes = sorted({code for _, code in ids_and_codes})
    parent = {code: code for code in codes}

    def root(code):
        while parent[code] != code:
            code = parent[code]
        return code

    for k, one in enumerate(codes):
        for other in codes[k + 1 :]:
            if (one ^ other).bit_count() <= 2:
                parent[root(one)] = root(other)
    least = defaultdict(list)
    for number, code in ids_and_codes:
        if number is not None:
            least[root(code)].append(number)
    return {code: min(least[root(code)], default=None) for code in codes}


def test_simhash_equals_brute_force(docs, rows):
    marked = [(r[0], brute_fingerprint(r[1])) for r in rows]
    component = brute_components(marked)
    want = Counter((number, f"{code:016x}", component[code]) for number, code in marked)
    assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == want


@pytest.mark.parametrize("limit", [50_000, 40])
def test_links_are_whole_in_dense_and_in_split_groups(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "GROUP_LIMIT", limit)
    rnd = random.Random(9)
    codes = {rnd.getrandbits(64) for _ in range(300)}
    codes |= {0xABCDEF << 40 | rnd.getrandbits(9) for _ in range(400)}  # many share all but nine bits
    codes |= {code ^ 1 << rnd.randrange(64) ^ 1 << rnd.randrange(64) for code in list(codes)[:100]}
    signed = [code - (1 << 64) if code >> 63 else code for code in codes]
    got = {frozenset(row) for row in simhash.links(spark.createDataFrame([(c,) for c in signed], "bits long")).collect()}
    whole = np.array(signed, dtype=np.int64).view(np.uint64)
    want = {
        frozenset((signed[i], signed[j]))
        for i in range(len(signed))
        for j in np.flatnonzero(np.bitwise_count(whole ^ whole[i]) <= 2)
        if j > i
    }
    assert got == want


def test_star_roots_on_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(-20, 80)] + [(500, 501)], "a long, b long")
    roots = {row.node: row.root for row in simhash.star_roots(edges).collect()}
    assert roots == {**{k: -20 for k in range(-19, 81)}, 501: 500}


def test_bpe_equals_the_library(spark, docs, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    rnd = random.Random(2)
    pool = ["aa", "a", "b", " ", "\n", "\t", "\x1c", "\x85", "\xa0", "<|endoftext|>", "é", "漢字", "🙂", "1", "'s", "'ll", "İ", "--", "\0", "The"]
    texts = ["".join(rnd.choices(pool, k=rnd.randint(0, 30))) for _ in range(400)] + ["a" * 3000, "ab" * 999, " " * 300]
    data = spark.createDataFrame([(k, text) for k, text in enumerate(texts)], "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    want = Counter()
    for number, text in [*enumerate(texts), *[(r[0], r[1] or "") for r in rows]]:
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        digest = lambda value: hashlib.sha256(value.encode()).hexdigest()
        want[(number, len(ids), digest(",".join(map(str, ids))), digest(decoded))] += 1
    assert Counter(map(tuple, bpe.encode(data, tokenizer_path()).collect())) == want


def sellers(pattern, text):
    """Fewest edits of the pattern against any part of the text."""
    before = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        now = [i]
        for j, b in enumerate(text, 1):
            now.append(min(before[j - 1] + (a != b), before[j] + 1, now[j - 1] + 1))
        before = now
    return min(before)


def test_decontamination_finds_exactly_what_is_within_the_budget():
    rnd = random.Random(4)
    line = lambda n: " ".join("".join(rnd.choices("etaoinshr", k=rnd.randint(2, 8))) for _ in range(n))
    found = 0
    for _ in range(40):
        item = line(12)[:90]
        changed = list(item)
        for _ in range(rnd.randint(0, 10)):
            at = rnd.randrange(len(changed))
            changed[at : at + 1] = rnd.choice([[], ["z"], [changed[at], "q"]])
        text = decontaminate.plain(line(8) + " " + "".join(changed) + " " + line(8))
        pieces = decontaminate.segments([(1, item)])
        least = sellers(pieces[0][1], text)
        got = list(decontaminate.find([line(5), text, None], decontaminate.Index(pieces)))
        want = least <= decontaminate.budget(len(pieces[0][1]))
        assert [(row[0], row[2]) for row in got] == ([(1, least)] if want else [])
        found += want
    assert 5 < found < 40


def test_decontamination_of_tables(spark, docs):
    item = "which of these words stands first in the list that the teacher wrote on the board this morning"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "short"), (1, item), (5, item.upper())], "item_id long, text string")
    more = spark.createDataFrame([(900, "x " + item + " y"), (901, item.replace("teacher", "teachers")), (902, item[:40])], "doc_id long, text string")
    data = docs.select("doc_id", "text").unionByName(more)
    got = {(r.doc_id, r.item_id, r.edits) for r in decontaminate.contaminated(data, bench).collect()}
    assert got == {(900, 1, 0), (900, 5, 0), (901, 1, 1), (901, 5, 1)}
    kept = decontaminate.drop_contaminated(data, bench)
    assert kept.columns == data.columns and kept.count() == data.count() - 2
    nothing = bench.limit(0)
    assert decontaminate.contaminated(data, nothing).count() == 0 and decontaminate.drop_contaminated(data, nothing).count() == data.count()


def test_spotsigs_next_edit_and_likeness(docs, rows):
    plain = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = Counter()
    for k, (number, text) in enumerate(plain):
        after = plain[(k + 1) % len(plain)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        want[(number, len(text), hashlib.sha256(edited.encode()).hexdigest())] += 1
    got = spotsigs.compare_edited(docs).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    by_text = defaultdict(set)
    texts = defaultdict(list)
    for r in rows:
        texts[r[0]].append(r[1])
    for r in got:
        if len(texts[r.doc_id]) == 1:
            by_text[texts[r.doc_id][0] or ""].add(r.fingerprint)
    assert all(len(prints) == 1 for prints in by_text.values())


def test_spotsigs_classes_and_pairs_equal_brute_force(spark):
    rnd = random.Random(8)
    content = [f"w{k}" for k in range(60)]
    base = [" ".join(rnd.choice(content) if rnd.random() < 0.7 else rnd.choice(["the", "of", "to"]) for _ in range(120)) for _ in range(6)]
    texts = []
    for text in base:
        for cut in (0, 0, 3, 9, 25):
            texts.append(" ".join(text.split()[: 120 - cut]))
    data = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, "", None, "zzz"])], "doc_id long, text string")
    classes, pairs = spotsigs.similar_classes(data)
    of = {r.doc_id: r.class_id for r in classes.collect()}
    prints = {r.doc_id: frozenset(r.fingerprint.split()) for r in spotsigs.compare_edited(data).collect()}
    want = {}
    for a in prints:
        for b in prints:
            alike = len(prints[a] & prints[b]) / len(prints[a] | prints[b])
            if of[a] < of[b] and alike >= 0.8:
                want[(of[a], of[b])] = round(alike, 9)
    assert {(r.a, r.b): round(r.likeness, 9) for r in pairs.collect()} == want
    assert want and all((of[a] == of[b]) == (prints[a] == prints[b]) for a in prints for b in prints)


def test_warc_round_trip(spark, tmp_path):
    digest = lambda html: base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()
    htmls = ["<p>é\r\n\r\nWARC/1.1\r\n</p>", "", None, "same", "same", "x" * 200_000, "same"]
    rows = [(k, f"http://a b\r\nc.test/{k}", html, "clash") for k, html in enumerate(htmls)]
    rows += [(3, None, "same", "clash"), (None, "u", "same", None), (None, "u", "alone", None), (-4, "u", "y", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha1 string")
    largest = {}
    for page, _, html, _ in rows:
        if page is not None:
            largest[digest(html)] = max(page, largest.get(digest(html), page))
    want = Counter()
    for page, _, html, _ in rows:
        first = largest.get(digest(html))
        role = ("response", None) if first is None or first == page else ("revisit", first)
        want[(page, len((html or "").encode()), digest(html), *role)] += 1
    got = warc.round_trip(pages).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    assert warc.round_trip(pages.limit(0)).count() == 0
    ends = defaultdict(list)
    for r in got:
        ends[r.archive].append((r.member_offset, r.member_offset + r.member_length))
    for spans in ends.values():  # members follow each other without a gap
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_inflate_takes_one_member_or_many():
    import gzip

    body = bytes(range(256)) * 3000
    assert b"".join(warc.inflated(gzip.compress(body))) == body
    assert b"".join(warc.inflated(gzip.compress(body) + gzip.compress(b"") + gzip.compress(b"tail"))) == body + b"tail"


def test_perspectives(spark):
    rows = [(1, t, r, x) for t, r, x in ((0, "system", "be"), (1, "ann", "hi"), (2, "bob", "yo"), (65, "ann", "ok"))]
    rows += [(2, 0, "system", "alone"), (None, None, None, None), (3, 0, "ann", "b"), (3, 0, "ann", "a"), (3, 0, "ann", "a")]
    got = {(r.conv_id, r.speaker, r.block): r for r in chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {(1, "ann", 0), (1, "ann", 1), (1, "bob", 0), (1, "bob", 1), (None, "unknown", None), (3, "ann", 0)}
    ann = got[(1, "ann", 0)]
    assert ann.text == "<|im_start|>system\nbe<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\nyo<|im_end|>\n"
    assert [ann.text[a:b] for a, b in ann.mask] == ["hi<|im_end|>"]
    assert got[(1, "bob", 1)].mask == [] and got[(3, "ann", 0)].n_turns == 3
    assert [got[(3, "ann", 0)].text[a:b][0] for a, b in got[(3, "ann", 0)].mask] == ["a", "a", "b"]


def test_url_rules_and_list(spark):
    urls = {
        "https://Example.COM/en/x": ("example.com/en/", "block"), "http://www.example.com/en/x": ("www.example.com/en/", "allow"),
        "http://a.example.com/de/": ("com/", "allow"), "http://com?x": (None, "allow"), "http://notexample.com/en/": ("com/", "allow"),
        "ftp://b.net/es/1#f": ("net/es/", "block"), "http://b.net/en/": (None, "allow"), "http://m.b.org/list/?q": (None, "block"),
        "http://b.org/list": (None, "block"), "http://b.org/lists": (None, "allow"), "no scheme": (None, "allow"), None: (None, "allow"),
    }
    pages = spark.createDataFrame([(k, url) for k, url in enumerate(urls)] * 2, "page_id long, url string")
    for extra in (0, 3000):
        listed = spark.createDataFrame([("b.org/list",), (None,), ("",)] + [(f"z.org/{k}",) for k in range(extra)], "canonical string")
        got = url_filter.judge(pages, listed).collect()
        assert Counter((r.page_id, r.rule, r.verdict) for r in got) == Counter([(k, *v) for k, v in enumerate(urls.values())] * 2)
    parts = {r.page_id: (r.host, r.path) for r in got}
    assert parts[0] == ("example.com", "/en/x") and parts[10] == ("", "") and parts[3] == ("com", "")


def test_bloom_filter_has_no_false_negatives(spark):
    listed = spark.range(5000).selectExpr("concat('a.test/', id) AS u")
    asked = spark.range(10_000).selectExpr("concat('a.test/', id) AS u", "id")
    got = url_filter.may_be_listed(asked, "u", listed, "u")
    assert got.filter("id < 5000 AND NOT possible").count() == 0
    assert got.filter("id >= 5000 AND possible").count() < 500


def brute_loss(texts, train, scale):
    """Mean loss per byte, with dictionaries in place of hashed tables."""
    counts = defaultdict(float)
    for text in train:
        data = b"\0" * 4 + text
        for k in range(4, len(data)):
            for key in ((5, data[k - 4 : k + 1]), (4, data[k - 4 : k]), (3, data[k - 2 : k + 1]), (2, data[k - 2 : k]), (1, data[k : k + 1])):
                counts[key] += scale
    tokens = sum(value for key, value in counts.items() if key[0] == 1)
    out = []
    for text in texts:
        data, loss = b"\0" * 4 + text, 0.0
        for k in range(4, len(data)):
            low = (counts[1, data[k : k + 1]] + 1) / (tokens + 256)
            low = (counts[3, data[k - 2 : k + 1]] + 4 * low) / (counts[2, data[k - 2 : k]] + 4)
            loss -= np.log((counts[5, data[k - 4 : k + 1]] + 4 * low) / (counts[4, data[k - 4 : k]] + 4))
        out.append(loss / max(1, len(text)))
    return out


def test_cross_entropy_difference_equals_brute_force(spark):
    texts = ["the cat sat on the mat", "zebra zebra", "", None, "é🙂 the mat", "the cat sat on the mat"]
    target = ["a cat on a mat", "the mat", None, "é"]
    data = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    goal = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    got = {r.doc_id: r for r in lm_scoring.score(data, goal).collect()}
    raw, aim = [(t or "").encode() for t in texts], [(t or "").encode() for t in target]
    scale = sum(map(len, aim)) / sum(map(len, raw))
    for k, (a, b) in enumerate(zip(brute_loss(raw, aim, 1.0), brute_loss(raw, raw, scale))):
        assert got[k].n_tokens == len(raw[k])
        assert got[k].target_loss == pytest.approx(a, abs=1e-4) and got[k].score == pytest.approx(a - b, abs=2e-4)
    assert all(r.score == pytest.approx(0, abs=1e-6) for r in lm_scoring.score(data, goal.limit(0)).filter("n_tokens = 0").collect())
