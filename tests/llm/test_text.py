import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from siltmill.llm import byte_bpe, containers, leakage, page_body, splitting, subword_trie, text_quality
from siltmill.llm.text_batch import TextBlock, blocks

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(3)
    pool = list("aabcst'’ \n\t  .,!?12½²éßñ中🌱̈ \x85\x1cllrevemd'''  \r\n")
    made = ["", " ", "\n", "it's they'll I'M x's't", " 's", "a" * 300, "<|endoftext|>", "  a  b\n\n c ", "🌱".encode("utf-16", "surrogatepass").decode("utf-16")]
    made += ["".join(rng.choice(pool) for _ in range(rng.randint(0, 50))) for _ in range(1500)]
    made += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    return made


def test_ids_are_exact(reference):
    bpe, made = byte_bpe.tokenizer(PATH), odd_texts()
    for begin, part in blocks(made, 5_000):
        ids, offsets = byte_bpe.encode_block(bpe, TextBlock(part))
        for i, t in enumerate(part):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == reference.encode_ordinary(t), repr(t)


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_ids_of_files_of_ranks(name):
    path = public_tokenizers.path(name)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    bpe, made = byte_bpe.tokenizer(path), [*odd_texts(), "Il faut dire que les livres ont toujours aimé la vallée.", "昨日の夜、私たちは小さな村の図書館で古い地図を見つけました。", "Вчера вечером мы нашли карту"]
    for _, part in blocks(made, 5_000):
        ids, offsets = byte_bpe.encode_block(bpe, TextBlock(part))
        for i, t in enumerate(part):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == own.encode_ordinary(t), repr(t)


def test_ids_of_a_table(spark):
    df = spark.createDataFrame([(1, "Hello world", "x"), (2, None, "y"), (3, "", "z"), (4, "Hello world", "x")], "doc_id bigint, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in byte_bpe.encode_texts(df, "doc_id", "text", PATH).collect()}
    assert got == {1: [15496, 995], 2: [], 3: [], 4: [15496, 995]}
    assert byte_bpe.encode_texts(df.limit(0), "doc_id", "text", PATH).count() == 0


def test_trie_counts_like_greedy_matching():
    rng, vocabulary = random.Random(1), [*"abcd", "ab", "abc", "bcd", "abcdab", "cc", "dab", "bab"]
    trie = subword_trie.SubwordTrie(vocabulary)

    def greedy(s):
        n = i = 0
        while i < len(s):
            i = max(j for j in range(i + 1, len(s) + 1) if s[i:j] in vocabulary)
            n += 1
        return n

    for _ in range(5000):
        s = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 16)))
        assert trie.count(s) == greedy(s), s
    assert trie.count("axb") == 3


def test_token_budget(spark):
    chunks = spark.createDataFrame([("s", 0, "FineWeb ", "Hello world"), ("s", 0, "fine_web", "Hello"), ("s", 1, None, None), ("t", 9, "dclm", "a")], "source_parquet string, source_row_index bigint, dataset_type string, chunk_body string")
    crawl = spark.createDataFrame(
        [("s", 0, "1", "eng_Latn", "HTTPS://www.Blog.A.example:80/x", 0.5, "2024-01-01"), ("s", 0, "1", "FR", "b.example/y", 0.1, "2024-02-01"), ("s", 1, "2", None, None, None, None)],
        "source_parquet string, source_row_index bigint, id string, language string, url string, language_score double, ingested_at string",
    )
    got = {(r["dataset_type"], r["language"], r["domain"]): (r["chunks"], r["chars"], r["tokens"], r["longest_match_tokens"]) for r in subword_trie.token_budget(chunks, crawl, PATH).collect()}
    assert got == {("fineweb", "fr", "b.example"): (2, 16, 3, 3), ("unknown", "unknown", "unknown"): (1, 0, 0, 0), ("dclm", "unknown", "unknown"): (1, 1, 1, 1)}


@pytest.mark.parametrize("seed", range(6))
def test_plans_hold_every_item(seed):
    rng = random.Random(seed)
    for _ in range(200):
        capacity = rng.randint(3, 40)
        counts: dict[int, int] = {}
        for _ in range(rng.randint(0, 60)):
            s = rng.randint(1, capacity)
            counts[s] = counts.get(s, 0) + rng.choice([1, 1, 5])
        held: dict[int, int] = {}
        for n, sizes in containers.pack_counts(dict(counts), capacity):
            assert n > 0 and sum(s * t for s, t in sizes) <= capacity
            for s, t in sizes:
                held[s] = held.get(s, 0) + n * t
        assert held == counts


def fewest(items, capacity):
    best = len(items)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + items[i] <= capacity and bins[j] not in bins[:j]:
                go(i + 1, [*bins[:j], bins[j] + items[i], *bins[j + 1 :]])
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best


def test_dominance_keeps_the_optimum():
    rng = random.Random(9)
    for _ in range(150):
        capacity = rng.randint(6, 20)
        items = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        counts: dict[int, int] = {}
        for s in items:
            counts[s] = counts.get(s, 0) + 1
        fixed = sum(n for n, _ in containers.dominant(counts, capacity))
        rest = [s for s, n in counts.items() for _ in range(n)]
        assert fixed + fewest(sorted(rest, reverse=True), capacity) == fewest(items, capacity)


@pytest.mark.parametrize("block_rows", [3, 100_000])
def test_containers(spark, block_rows):
    rng = random.Random(2)
    sizes = [(i, rng.choice([0, 1, 5, 5, 5, 9, 10, 25, 37])) for i in range(200)] + [(999, None)]
    config = spark.createDataFrame([(1, "t", 10), (2, "t", 16), (2, "t", 16)], "pack_id int, tokenizer string, capacity int")
    got = containers.pack_texts(spark.createDataFrame(sizes, "doc_id bigint, tokens bigint"), config, block_rows=block_rows).collect()
    for pack, capacity in ((1, 10), (2, 16)):
        mine = [r for r in got if r["pack_id"] == pack]
        fill: dict[int, int] = {}
        for r in mine:
            fill[r["container"]] = fill.get(r["container"], 0) + r["piece_tokens"]
        assert max(fill.values()) <= capacity
        assert sorted(fill) == list(range(len(fill)))
        for i, n in sizes:
            parts = [r["piece_tokens"] for r in mine if r["doc_id"] == i]
            assert sum(parts) == (n or 0) and len(parts) == max(1, -(-(n or 0) // capacity))
        total = sum(fill.values())
        assert len(fill) <= -(-total // capacity) * 1.25 + 1
    assert containers.pack_texts(spark.createDataFrame([], "doc_id bigint, tokens bigint"), config).count() == 0
    assert {r["pack_id"] for r in containers.fill_report(spark.createDataFrame(got)).collect()} == {1, 2}


def test_pieces():
    rng = random.Random(4)
    for _ in range(400):
        text = "".join(rng.choice(["word ", "a", "End. ", "\n", "\n\n", "日本語", "é́", "x" * 30]) for _ in range(rng.randint(0, 120)))
        limit, overlap = rng.choice([None, 0, -1, 1, 7, 50, 200]), rng.choice([None, -1, 0, 1, 6, 49, 300])
        found = splitting.pieces_of(text, limit, overlap)
        assert found[0][0] == 0 and found[-1][1] == len(text)
        if not limit or limit < 1 or len(text) <= limit:
            assert len(found) == 1
            continue
        shared = max(overlap or 0, 0)
        shared = shared if shared < limit else limit // 2
        assert all(0 < b - a <= limit for a, b in found)
        assert all(y[0] == x[1] - shared for x, y in zip(found, found[1:]))


def cheapest_cost(text, limit, overlap, kinds):
    """Every boundary from every boundary, without any bound."""
    n = len(text)
    pieces = -(-(n - overlap) // (limit - overlap))
    even = (n - overlap) / pieces + overlap
    cost_at = {x: splitting.CUT_COSTS[k] for k, positions in enumerate(kinds) for x in positions}
    best, end = {0: 0.0}, float("inf")
    todo = [0]
    while todo:
        at = min(todo)
        todo.remove(at)
        start = at - overlap if at else 0
        if start + limit >= n:
            end = min(end, best[at] + splitting.IMBALANCE * ((n - start - even) / limit) ** 2)
            continue
        found = [x for x in cost_at if at < x <= start + limit and cost_at[x] < 5]
        for to in found or [splitting._whole_character(text, start + limit, at + 1)]:
            total = best[at] + cost_at.get(to, splitting.CUT_COSTS[5]) + splitting.IMBALANCE * ((to - start - even) / limit) ** 2
            if to not in best:
                todo.append(to)
            best[to] = min(best.get(to, float("inf")), total)
    return end


def test_pieces_are_the_cheapest():
    rng = random.Random(11)
    for _ in range(250):
        text = "".join(rng.choice(["word ", "a, ", "some words. ", "End. ", "\n", "\n\n", "longer, words ", "x" * 25]) for _ in range(rng.randint(10, 90)))
        limit = rng.choice([20, 40, 75, 120])
        overlap = rng.choice([0, 0, 3, limit // 4])
        if len(text) <= limit:
            continue
        kinds = splitting.boundaries(text)
        bound, _ = splitting._search(text, kinds, limit, overlap, float("inf"), narrow=True)
        cost, ends = splitting._search(text, kinds, limit, overlap, bound + 1e-9, narrow=False)
        assert cost == pytest.approx(cheapest_cost(text, limit, overlap, kinds))
        assert cost <= bound + 1e-9 and [b for _, b in splitting.cut_points(text, limit, overlap)] == ends


def test_pieces_end_at_boundaries():
    text = "One two three. Four five six.\n\nSeven eight nine ten. Eleven twelve.\nThirteen fourteen."
    ends = [text[:b] for _, b in splitting.pieces_of(text, 40, 0)][:-1]
    assert all(e.endswith(("\n", ". ")) for e in ends)


def test_split_table(spark):
    df = spark.createDataFrame([(1, "abc def ghi", 5, 0, "k"), (2, None, 5, 0, "k"), (3, "abcdef", 0, 9, "k"), (4, "abcdef", 5, None, "k"), (4, "abcdef", 5, None, "k")], "chunk_id bigint, body string, size int, ov int, key string")
    got = splitting.split_texts(df, "chunk_id", "body", "size", "ov").collect()
    assert "".join(r["piece_text"] for r in sorted((r for r in got if r["chunk_id"] == 1), key=lambda r: r["piece"])) == "abc def ghi"
    assert all(r["overlap_kept"] for r in got)
    wide = splitting.split_texts(df.withColumn("ov", F.lit(5)), "chunk_id", "body", "size", "ov").where("pieces > 1").collect()
    assert wide and not any(r["overlap_kept"] for r in wide)
    assert sorted(r["chunk_id"] for r in splitting.must_split(df, "chunk_id", "body", "size", "ov").collect()) == [1, 4, 4]


def brute_leaks(text, sequences):
    words = leakage.item_words(text)
    out = set()
    for s in sequences:
        n = len(s.words)
        for place in range(-n, len(words)):
            equal = np.array([0 <= place + j < len(words) and words[place + j] == s.words[j] for j in range(n)])
            if (leakage.longest_passage(equal) >= s.least) if s.is_query else equal.all():
                out.add(s.item)
    return out


def test_leaks_against_brute_force():
    rng = random.Random(8)
    vocabulary = [f"word{i}" for i in range(80)]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)).capitalize() + "."
    items = [(f"i{k}", f"{sentence(10)} {sentence(11)} {sentence(9)} Which of these is true?", [sentence(9), "no"]) for k in range(40)]
    items.append(("copy", items[0][1], items[0][2]))
    items += [(f"s{k}", "Which of these is true?", [f"x{k}"]) for k in range(5)] + [("none", None, None)]
    sequences = leakage.item_sequences(items)
    assert all("which" not in s.words for s in sequences if s.is_query)
    texts = ["", " ", "Which of these is true?"]
    for _ in range(200):
        item = rng.choice(items[:40])
        words = leakage.item_words(item[1].rpartition(" Which")[0])
        n = rng.choice([8, 14, 15, 16, 22, 30])
        at = rng.randint(0, len(words) - n)
        part = words[at : at + n]
        for j in range(rng.randint(3, 9), n - 2, 9):
            if rng.random() < 0.5:
                part[j] = "other"
        body = rng.choice([" ".join, " <b>".join, ",\n".join])(part).upper()
        texts.append(f"{sentence(12)} {body} {sentence(7)}" + (f" {item[2][0]}" if rng.random() < 0.2 else ""))
    index = leakage.ItemIndex(sequences)
    found = index.verified(TextBlock([leakage.without_markup(t) for t in texts]))
    expected = {(i, x) for i, t in enumerate(texts) for x in brute_leaks(t, sequences)}
    assert len(found - expected) <= 1
    assert len(found) >= 0.97 * len(expected)
    assert {x for _, x in found} >= {"copy", "i0"} or not any(x == "i0" for _, x in expected)


def test_leak_table(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    items = spark.createDataFrame([("a", text, None), ("b", None, [text]), ("c", "other words entirely here", ["short"])], "id string, query string, choices array<string>")
    rows = spark.createDataFrame([(1, f"<p>{text.upper()}!</p>", "z"), (2, None, "z"), (3, "alpha beta gamma", "z")], "chunk_id bigint, chunk_body string, item_id string")
    got = sorted(map(tuple, leakage.leaked_items(rows, items, "chunk_id", "chunk_body").collect()))
    assert got == [(1, "a"), (1, "b")]
    assert leakage.leaked_items(rows, items.limit(0), "chunk_id", "chunk_body").count() == 0


@pytest.mark.parametrize("words,edits", [(6, 0), (7, 0), (7, 1), (8, 1), (9, 1), (10, 1), (12, 1), (14, 2), (16, 2), (21, 3)])
def test_recall_of_short_passages(words, edits):
    """Half of a query with words replaced inside it, as many as count: at least 0.93 are found at every length."""
    rng = random.Random(words * 10 + edits)
    pool = [f"w{i}x" for i in range(3000)]
    some = lambda n: [rng.choice(pool) for _ in range(n)]
    items, texts = [], []
    for i in range(300):
        query = some(2 * words)
        at = rng.randint(0, words)
        part, places = query[at : at + words], []
        while len(places) < edits:
            x = rng.randint(1, words - 2)
            if all(abs(x - y) > 1 for y in places):
                places.append(x)
                part[x] = f"other{i}"
        items.append(leakage.Sequence_(f"i{i}", True, query))
        texts.append(" ".join(some(15) + part + some(15)))
    found = leakage.ItemIndex(items).verified(TextBlock(texts))
    assert sum((i, f"i{i}") in found for i in range(300)) >= 0.93 * 300


def test_passages_that_stand_twice():
    """A passage with a word left out is found, once or several times, near or far."""
    query = [f"q{i}" for i in range(24)]
    part = query[:8] + query[9:16]
    fill = [f"f{i}" for i in range(50)]
    index = leakage.ItemIndex([leakage.Sequence_("a", True, query)])
    texts = [part, part + fill + part, fill[:3] + part + fill[:3] + part, fill + part + fill * 9 + part]
    assert index.verified(TextBlock([" ".join(t) for t in texts])) == {(i, "a") for i in range(len(texts))}
    assert leakage.near_diagonals([5, 100, 6, 300, 103], [3, 4, 2, 9, 1]) == [([5, 6], 5), ([100, 103], 5)]


@pytest.mark.parametrize("most_items,most_words", [(1, 10**6), (10**6, 12), (3, 30)])
def test_blocks_of_items_give_each_pair_once(spark, monkeypatch, most_items, most_words):
    monkeypatch.setattr(leakage, "MAX_ITEMS", most_items)
    monkeypatch.setattr(leakage, "MAX_WORDS", most_words)
    words = [" ".join(f"{c}{i}" for i in range(10)) for c in "abc"]
    items = spark.createDataFrame([(c, w, [w, w[::-1]]) for c, w in zip("abc", words)] + [("none", None, None)], "id string, query string, choices array<string>")
    rows = spark.createDataFrame([(1, words[0] + " and " + words[1]), (2, words[2]), (3, "nothing here"), (4, None)], "chunk_id bigint, chunk_body string")
    assert sorted(map(tuple, leakage.leaked_items(rows, items, "chunk_id", "chunk_body").collect())) == [(1, "a"), (1, "b"), (2, "c")]


def test_too_many_items_are_refused(spark, monkeypatch):
    monkeypatch.setattr(leakage, "MOST_ITEMS", 2)
    items = spark.createDataFrame([(str(i), "q", None) for i in range(3)], "id string, query string, choices array<string>")
    with pytest.raises(ValueError, match="items"):
        leakage.leaked_items(spark.createDataFrame([(1, "x")], "k bigint, t string"), items, "k", "t")


def test_markup():
    words = leakage.item_words
    assert words("foo<br>bar</p><p>baz") == ["foo", "bar", "baz"]
    assert words('<td class="' + "x" * 900 + '">a</td><td>b</td>') == ["a", "b"]
    assert words("wo<b>rd</b> x<sup>2</sup> a&amp;b 3 < 4 > 2") == ["word", "x2", "a", "b", "3", "4", "2"]


def test_edited_passage():
    words = np.arange(1, 21, dtype=np.uint64)
    text = np.concatenate((np.array([90, 91]), words[:8], words[9:20], np.array([92]))).astype(np.uint64)
    assert leakage.edited_passage(words, text) == 19


PROSE = "It took Ann 48 weeks to learn that the pulse could not be compared alone. Perhaps the trials were small from the beginning, and we only noticed it before noon."


@pytest.mark.parametrize(
    "text,kind",
    [
        (PROSE, "prose"), (PROSE.upper(), "prose"), (PROSE.lower().replace(".", "\n").replace(",", ""), "prose"), ("Il faut dire que les livres ont toujours aimé la vallée, surtout pendant l'hiver.", "prose"),
        (PROSE + "\n* one thing\n* two things\n* three", "prose"), ("\n".join(f"* old thing {i}" for i in range(9)), "list"), ("old wages; rough prices; plain receipts; gentle clerks; cold fees; empty ledgers", "list"), ("a | 3 | 5%\nb | 4 | 7%\nc | 1 | 2%", "table"),
        ("=====\n" * 9, "junk"), ((PROSE[:74] + " ") * 6, "junk"), ("dJu8c6yerKisMJQd2um6qJpqcSydQHGjQqMv219yLz6P7qd5qkO2umiZENlqTjJmk4Qr9a4cD0yHfhCrA52", "junk"), ("", "empty"), (None, "empty"), (" \n\t ", "empty"),
        ("News | Shop | About us\nHome\nContact\nPress", "list"), ("Jedno przykładowe zdanie składające się z wielu zwykłych słów, które tworzą sensowną i dłuższą całość.", "prose"),
        ("Wczoraj wieczorem znaleźliśmy w małej wiejskiej\nbibliotece starą mapę, ale nikt nie znał jej nazwy\nani miejsca, które pokazywała. Dopiero rano nauczycielka\nprzypomniała sobie opowieść swojego dziadka.", "prose"),
        ("Eilen illalla löysimme kylän pienestä kirjastosta\nvanhan kartan, mutta kukaan ei tuntenut sen nimeä eikä\npaikkaa, jota se esitti. Vasta aamulla opettaja muisti\nisoisänsä kertomuksen siitä.", "prose"),
        ("\n".join(["Ten steps along the river.", "A walk to the mill."] * 6), "junk"), ("\n\n".join(["We walked along the river before noon."] * 7), "junk"), ("buy now " * 9 + "today we went home and saw the rain over hills.", "junk"),
        ("昨日の夜、私たちは小さな村の図書館で古い地図を見つけました。誰もその名前を知りませんでした。", "prose"), ("Вчера вечером мы нашли в маленькой деревенской библиотеке старую карту, и никто не знал её имени.", "prose"),
    ],
)
def test_kinds(text, kind):
    assert text_quality.block_stats(TextBlock([text or ""]))["kind"][0] == kind


def test_statistics(spark):
    df = spark.createDataFrame([(1, "The cat.\nThe cat.\n\nThe cat."), (2, None), (3, PROSE), (3, PROSE)], "k bigint, kind string").withColumnRenamed("kind", "chars")
    got = {r["k"]: r for r in text_quality.text_statistics(df, "k", "chars").collect()}
    assert (got[1]["words"], got[1]["lines"], got[1]["duplicate_line_share"], got[1]["line_end_share"]) == (6, 4, 2 / 3, 1.0)
    assert got[1]["duplicate_paragraph_share"] == 0 and got[1]["common_word_share"] == 0.5 and got[2]["chars"] == 0
    assert text_quality.not_prose(df.where("k > 1"), "k", "chars").count() == 0
    assert text_quality.text_statistics(df.limit(0), "k", "chars").count() == 0


def test_repetition_against_brute_force():
    rng = random.Random(6)
    made = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(50)]
    top, again = text_quality.ngram_repetition(TextBlock(made), 2)
    for t, x, y in zip(made, top, again):
        w = t.split()
        grams = list(zip(w, w[1:]))
        assert y == pytest.approx((len(grams) - len(set(grams))) / len(grams) if grams else 0)
        most = max((grams.count(g) for g in grams), default=0)
        assert x == pytest.approx(min(1, most * 3 / len(t)) if most > 1 else 0)


LANGUAGES = {
    "en": (
        "Home|News|About us|Gallery|Contact|Press", "We use cookies to improve your visit to this site. Accept all Reject Settings", "Skip to main content", "Most read", "Leave a reply Cancel reply", "All rights reserved by the owner", "Powered by {}",
        ["The {0} stood near the {1} until the {2} came home in winter.", "Nobody had seen the {0} before the {1} was brought to the {2}.", "When the {1} was old, the {0} and the {2} were left behind."], ["Why the {0} still matters", "A short history of the {0}", "Letters about the {0}"],
    ),
    "it": (
        "Notizie|Chi siamo|Contatti|Galleria|Negozio|Stampa", "Questo sito utilizza i cookie per migliorare la visita. Accetta tutti Rifiuta Impostazioni", "Vai al contenuto principale", "Articoli recenti", "Accedi per lasciare una risposta", "Tutti i diritti riservati", "Realizzato con {}",
        ["Ieri sera {0} si trovava ancora vicino a {1}, e {2} non era lontano.", "Nessuno aveva mai visto {0} prima che {1} arrivasse da {2}.", "Quando {1} era vecchio, {0} e {2} rimasero indietro."], ["Perché {0} conta ancora oggi", "Breve storia di {0}", "Lettere su {0}"],
    ),
    "pl": (
        "Aktualności|O nas|Kontakt|Galeria|Sklep|Prasa", "Ta strona używa plików cookie, aby ulepszyć wizytę. Akceptuj wszystkie Odrzuć Ustawienia", "Przejdź do treści", "Najczęściej czytane", "Zaloguj się, aby dodać komentarz", "Wszelkie prawa zastrzeżone", "Wspierane przez {}",
        ["Wczoraj wieczorem {0} stał jeszcze obok {1}, a {2} był niedaleko.", "Nikt nie widział wcześniej {0}, zanim {1} przybył z {2}.", "Gdy {1} był stary, {0} oraz {2} zostali z tyłu."], ["Dlaczego {0} wciąż jest ważny", "Krótka historia {0}", "Listy o {0}"],
    ),
}


def pages(language, n, rng):
    """Pages of one language with the numbers of their site's lines."""
    sections, consent, skip, heading, reply, rights, powered, sentences, titles = LANGUAGES[language]
    name = lambda: "".join(rng.choice(["ba", "ro", "ti", "lu", "ne", "ka", "so"]) for _ in range(4))
    sections, sites = sections.split("|"), [name().title() for _ in range(12)]
    out = []
    for _ in range(n):
        lines, site = [], []

        def add(line, ours, lines=lines, site=site):
            if ours:
                site.append(len(lines))
            lines.append(line)

        title = lambda: rng.choice(titles).format(name())
        if rng.random() < 0.5:
            add(skip, True)
        if rng.random() < 0.7:
            add(rng.choice([" | ", " · ", " "]).join(rng.sample(sections, 4)), True)
        else:
            for x in rng.sample(sections, 3):
                add(f"* {x}", True)
        if rng.random() < 0.4:
            add(consent, True)
        add(title(), False)
        for _ in range(rng.randint(1, 3)):
            add(" ".join(rng.choice(sentences).format(name(), name(), name()) for _ in range(2)), False)
            lines.append("")
        if rng.random() < 0.4:
            add(f"* {name()} (19{rng.randint(10, 99)})", False)
            add(f"* {name()} (19{rng.randint(10, 99)})", False)
        if rng.random() < 0.3:
            add(heading, True)
            for _ in range(3):
                add(title(), True)
        if rng.random() < 0.5:
            add(reply, True)
        if rng.random() < 0.5:
            add(f"© {rng.randint(2001, 2024)} {rng.choice(sites)}", True)
        if rng.random() < 0.5:
            add(rights, True)
        if rng.random() < 0.5:
            add(powered.format(rng.choice(sites)), True)
        out.append(("\n".join(lines), site))
    return out


@pytest.mark.parametrize("language", LANGUAGES)
def test_pages_of_any_language(language):
    """Links are learned from the pages, so no language needs a list. Held-out pages of other texts are classified."""
    rng = random.Random(7)
    links = page_body.sample_links([t for t, _ in pages(language, 300, rng)])
    hit = wrong = missed = 0
    for text, site in pages(language, 200, rng):
        found = {i for i, k in enumerate(page_body.page_classes(text.split("\n"), links, {})) if k == page_body.SITE}
        hit, wrong, missed = hit + len(found & set(site)), wrong + len(found - set(site)), missed + len(set(site) - found)
    assert hit / (hit + wrong) > 0.95 and hit / (hit + missed) > 0.9


def test_page_table(spark):
    rng = random.Random(8)
    made = pages("it", 120, rng)
    rows = [(i, t, 7) for i, (t, _) in enumerate(made)] + [(1000, None, 7), (1001, "", 7), (1002, " \n ", 7), (1003, PROSE, 7), (1004, PROSE, 7)]
    df = spark.createDataFrame(rows, "chunk_id bigint, chunk_body string, line_no int")
    links = page_body.corpus_links(df, "chunk_body")
    assert links == page_body.sample_links([t or "" for _, t, _ in rows])
    found: dict[int, set] = {}
    for r in page_body.site_lines(df, "chunk_id", "chunk_body").collect():
        found.setdefault(r["chunk_id"], set()).add(r["line_no"])
    for i, (text, _) in enumerate(made):
        assert found.get(i, set()) == {n for n, k in enumerate(page_body.page_classes(text.split("\n"), links, {})) if k == page_body.SITE}
    got = {r["chunk_id"]: r for r in page_body.main_text(df, "chunk_id", "chunk_body").collect()}
    assert len(got) == 125 and got[1000]["main_text"] == got[1001]["main_text"] == "" and got[1003]["main_text"] == PROSE
    assert all(got[i]["site_lines"] == len(found.get(i, ())) for i in range(120))
    empty = df.limit(0)
    assert page_body.site_lines(empty, "chunk_id", "chunk_body").count() == page_body.main_text(empty, "chunk_id", "chunk_body").count() == 0


def test_labels_recur_whatever_the_number_of_pages(spark):
    """300 pages with a thousand lines each of their own do not take a label off the four pages that it stands on."""
    rng = random.Random(11)
    line = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4)).title() + " zq"
    few = [t for t, _ in pages("en", 40, rng)] + ["Imprint of the house\nSome text of the page."] * 4
    many = few + ["\n".join(map(line, range(i, i + 1000))) for i in range(0, 300_000, 1000)]
    small, large = (page_body.corpus_links(spark.createDataFrame([(t,) for t in x], "chunk_body string").repartition(4), "chunk_body") for x in (few, many))
    assert "Imprint of the house" in small.links
    assert small == large


def test_a_line_said_again_and_again_is_no_link():
    rng = random.Random(10)
    links = page_body.sample_links([t for t, _ in pages("en", 200, rng)])
    classes = lambda t: page_body.page_classes(t.split("\n"), links, {})
    assert set(classes("Gallery\n" * 6 + "Gallery")) == {page_body.MAIN} and set(classes("Gallery\nNews\nGallery\nContact")) == {page_body.SITE}


def test_long_notices_are_judged_like_short_ones():
    rng = random.Random(9)
    notice = "Our partners and our own website set cookies and store identifiers on every device, among them those for measurement, advertising, personalisation, audience research and product development, for the period stated in the notice. Accept everything Manage choices"
    made = [f"{notice}\n{t}" for t, _ in pages("en", 60, rng)]
    links = page_body.sample_links(made)
    assert len(notice) > 250
    assert all(page_body.page_classes(t.split("\n"), links, {})[0] == page_body.SITE for t in made)


def test_blocks_keep_order_and_nulls():
    made = ["a" * n for n in (5, 0, 30, 2)] + [None]
    assert [(b, len(p)) for b, p in blocks(made, 10)] == [(0, 2), (2, 1), (3, 2)]
    assert [t for _, p in blocks(made, 10) for t in p] == [t or "" for t in made]
    assert list(blocks([])) == []


def test_columns_do_not_clash(spark):
    df = spark.createDataFrame([(1, PROSE, "e")], "key bigint, text string, ids string").withColumn("piece", F.lit(1))
    assert byte_bpe.token_counts(df, "key", "text", PATH).columns == ["key", "tokens"]
