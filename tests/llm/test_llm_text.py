"""Archives by round trip, token counts against whole encodings, contamination against a plain alignment."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from leakgauge.llm import contamination, tokens, warc
from leakgauge.llm.store import shared_folder, table

PAGES = "page_id long, url string, html string, payload string, records int"


def page_rows():
    rng = random.Random(2)
    shared = "<p>" + "copy " * 60 + "</p>"
    texts = [None, "", "short", "short", shared, shared, shared, "x" * 99, "x" * 99, "y" * 100, "y" * 100, "é\r\n\r\n" * 60, "\x00" * 300]
    texts += ["<html>" + " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randint(5, 900))) for _ in range(40)]
    rows = [(50 - i, f"http://e/{i}\r\nX: y", t, "z", 1) for i, t in enumerate(texts)]
    return rows + [rows[5], rows[9], (None, None, shared, None, None), (None, None, None, None, None)]


def roles(rows):
    first = {}
    for i, _, t, *_ in rows:
        data = (t or "").encode()
        if len(data) >= 100 and i is not None:
            first[data] = min(i, first.get(data, i))
    for i, _, t, *_ in rows:
        data = (t or "").encode()
        f = first.get(data)
        again = f is not None and i != f
        yield i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", f if again else None


@pytest.mark.parametrize("size", [24 << 20, 3000])
def test_archives_round_trip(spark, size, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", size)
    rows = page_rows()
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    got = warc.archived_pages(pages).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == Counter(roles(rows))
    folder = shared_folder(spark, "warc")
    listed = warc.write_archives(pages, folder).collect()
    assert sum(r.records for r in listed) == len(rows)
    back = warc.read_archives(spark, folder).collect()
    want = Counter((i, " ".join((u or "").split()), (t or "").encode()) for (i, u, t, *_), role in zip(rows, roles(rows)) if role[3] == "response")
    assert Counter((r.page_id, r.url, bytes(r.payload)) for r in back if r.payload is not None) == want


def test_no_pages_give_no_archives(spark):
    assert warc.archived_pages(spark.createDataFrame([], PAGES)).count() == 0


def test_archive_has_a_leading_dictionary_and_separate_frames():
    rng = random.Random(1)
    records = [warc.record(i, "http://e", " ".join(rng.choice("abcdefgh") * rng.randint(3, 9) for _ in range(200)).encode(), "d", "response", None) for i in range(300)]
    data = warc.archive(records)
    assert data[:4] == (0x184D2A5D).to_bytes(4, "little")
    assert list(warc.frames(data)) == records
    assert list(warc.frames(warc.archive(records[:2]))) == records[:2]
    with pytest.raises(Exception):
        list(warc.frames(data[:-3]))
    assert data.count(warc.FRAME) >= 300


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_token_counts(awkward, awkward_rows, nothing, model, monkeypatch):
    want = Counter((i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096) for i, t, *_ in awkward_rows)
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(awkward).collect())
    assert got == want
    assert tokens.token_counts(nothing).count() == 0


def test_token_counts_of_a_given_table(spark, sf_dir, model):
    docs = table(spark, sf_dir, "documents")
    want = {r.doc_id: len(model.encode(r.text or "")) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in tokens.token_counts(docs).collect()} == want


def test_spliced_counts_equal_whole_counts(model):
    rng = random.Random(4)
    alphabets = ["ab ", "abc  d\n", "▁ a", "é日本 x", "😀a ", "abcdefgh", "a", " ", "<s> </un"]
    for trial in range(120):
        text = "".join(rng.choice(alphabets[trial % len(alphabets)]) for _ in range(rng.randint(0, 900)))
        for chunk, overlap in ((40, 6), (64, 1), (200, 50)):
            assert tokens.count_huge(model, text, chunk, overlap) == len(model.encode(text)), (text, chunk)
    words = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 12))) for _ in range(30_000))
    assert tokens.count(model, True, [words, "x"], huge=1000) == [len(model.encode(words)), len(model.encode("x"))]


def edit_distance(item, text):
    """Least distance of the item to any region of the text."""
    cost = np.zeros(len(text) + 1, int)
    t = np.array(list(text))
    for r, c in enumerate(item):
        fresh = np.empty_like(cost)
        fresh[0] = r + 1
        fresh[1:] = np.minimum(cost[:-1] + (t != c), cost[1:] + 1)
        cost = np.minimum.accumulate(fresh - np.arange(len(fresh))) + np.arange(len(fresh))
    return int(cost.min())


def plain(text):
    """Letters folded where the fold is one code point, white space as one space."""
    fold = lambda c: next((f for f in (c.casefold(), c.lower()) if len(f) == 1), c)
    return " ".join("".join(map(fold, text or "")).split(None))


def words_only(item, text):
    """Whether a short item stands in the text and no word runs on across its ends."""
    word = lambda c: c.isalnum() and ord(c) < 0x0E00
    ends = lambda k: 0 < k < len(text) and word(text[k - 1]) and word(text[k])
    return any(text.startswith(item, k) and not ends(k) and not ends(k + len(item)) for k in range(len(text)))


def holds(item, text):
    """Whether a folded text holds a folded item."""
    if len(item) < contamination.Q:
        return bool(item) and words_only(item, text)
    return bool(text) and edit_distance(item, text) <= contamination.budget(len(item))


def noisy(rng, text, edits):
    chars = list(text)
    for _ in range(edits):
        at, kind = rng.randrange(len(chars)), rng.randrange(3)
        if kind == 0:
            chars[at] = rng.choice("xyz")
        elif kind == 1:
            chars.insert(at, rng.choice("xyz"))
        else:
            del chars[at]
    return "".join(chars)


def test_contamination_equals_plain_alignment(spark, nothing):
    rng = random.Random(7)
    line = lambda n: " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 6))) for _ in range(n))
    items = [(i, line(rng.randint(8, 50))) for i in range(25)] + [(90, None), (91, ""), (92, "ab"), (93, "abcdefghij"), (94, "Ünïcode ÄÖ " * 6)]
    docs = [(1, None), (2, ""), (3, "abcdefghij"), (4, line(3000))]
    for i, t in items[:25]:
        for edits in (0, 3, len(t) // 10, len(t) // 10 + 6):
            docs.append((len(docs) + 10, line(30) + " " + noisy(rng, t, edits).upper().replace(" ", " \n", 3) + " " + line(rng.randint(0, 60))))
    docs.append((900, docs[10][1] + items[0][1] + items[94 - 90 + 25][1]))
    docs.append((None, items[1][1]))
    want = {(d, i) for d, t in docs for i, item in items if holds(plain(item), plain(t))}
    d = spark.createDataFrame([(i, t, 5, "s") for i, t in docs], "doc_id long, text string, item_id int, distance string")
    b = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, doc_id int")
    got = contamination.contaminated(d, b).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    texts, names = dict(docs), dict(items)
    for r in got:
        region, item = f" {plain(texts[r.doc_id][r.start:r.end])} ", plain(names[r.item_id])
        assert edit_distance(item, region) <= r.distance <= contamination.budget(len(item))
    assert contamination.contaminated(nothing.select("doc_id", "text"), b).count() == 0
    assert contamination.contaminated(d, b.limit(0)).count() == 0


def test_short_items_and_letters_of_any_script(spark):
    rng = random.Random(12)
    short = ["a", "Ж", "42", "yes", "ΝΑΙ", "ночь", "C++", "a b", "ab cd e", "東京", "日", "-", " ", "ſo", "aa"]
    long = ["Съешь же ещё этих мягких французских булок, да выпей чаю", "ΞΕΣΚΕΠΑΖΩ ΤΗΝ ΨΥΧΟΦΘΟΡΑ ΒΔΕΛΥΓΜΙΑ ΤΟΥ ΟΔΟΣ ΚΟΣΜΟΣ",
            "Zażółć gęślą jaźń, pchnąć w tę łódź jeża lub ośm skrzyń fig", "ΣΊΣΥΦΟΣ Ώ"]
    items = [*enumerate([*short, *long, "YES"])]
    texts = [None, "", *short, *long, *(t.upper() for t in long), *(t.lower() for t in long), "yesterday no", "no, yes.", "A\n\tB", "xa b",
             "a aa aaa aaaa", "-aa-aa aa", "東京大学は日本", "eyes YES yes", "ΟΝΑΙ ναι", "НОЧЬю", "ab  CD e", "c+++", "c++", "142 42 4 2", "SO so"]
    letters = "aA bB жЖ νΝ ς Σ σ 42 - 東 日 ſ s"
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    texts += [noisy(rng, rng.choice(long).upper(), 4) + " " + rng.choice(short) for _ in range(20)]
    docs = [*enumerate(texts)]
    want = {(d, i) for d, t in docs for i, item in items if holds(plain(item), plain(t))}
    got = contamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"),
                                     spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert len(want) > 100
    names = dict(items)
    for r in got:
        if len(plain(names[r.item_id])) < contamination.Q:
            assert plain(texts[r.doc_id][r.start:r.end]) == plain(names[r.item_id]) and r.distance == 0


def test_pieces_and_parts_change_nothing(spark, monkeypatch):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(40))) for i in range(6)]
    text = " ".join(word() for _ in range(2000)).split()
    for k, (_, t) in enumerate(items):
        text[300 * k:300 * k] = [noisy(rng, t, 5)]
    d = spark.createDataFrame([(1, " ".join(text))], "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, contamination.contaminated(d, b).collect()))
    assert len(whole) == 6
    monkeypatch.setattr(contamination, "PIECE", 700)
    monkeypatch.setattr(contamination, "PART_CHARS", 300)
    hits = [h for part in contamination.benchmark_parts(b) for h in contamination.occurrences(part, " ".join(text))]
    assert sorted((1, *h) for h in hits) == whole
