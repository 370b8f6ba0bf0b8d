"""Operators 2, 3, 5 and 10."""

import base64
import random
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import bpe, language_id, packing, pii
from tests.llm.helpers import corpus, empty, frame

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    return frame(spark, corpus(7), tmp_path_factory.mktemp("text"))


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(reference):
    encode = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    rnd = random.Random(3)
    pool = [chr(i) for i in range(0x400)] + list("​ 　字한😀𝒳﻿") + list(" \n\t'sabe ") * 60
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    texts += ["a" * 5000, " " * 3000, "ab" * 4000, "\n" * 200, "<|endoftext|> x", "é" * 999, "it's  \n x", "\x1c\x85 \xa0"]
    for text in texts:
        ids = encode(text).tolist()
        assert ids == reference.encode_ordinary(text)
        assert encode.vocabulary.decode(ids) == text.encode()


def test_bpe_memo_keeps_results(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 8)
    encode = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    text = " ".join(f"word{i % 13}x" for i in range(200))
    assert encode(text).tolist() == bpe.Encoder(RANKS, public_tokenizers.PATTERN)(text).tolist()
    assert len(encode.kept) <= 9


def test_bpe_tables_are_bounded(monkeypatch, reference, spark):
    monkeypatch.setattr(bpe, "FITS", 4)
    monkeypatch.setattr(bpe, "DECODED", 3)
    monkeypatch.setattr(bpe, "_ENCODERS", {})
    encode = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    for text in ("antidisestablishmentarianism", "xqzkjw" * 50, "ab" * 300):
        assert encode(text).tolist() == reference.encode_ordinary(text)
        assert len(encode.vocabulary.fits) <= 4


def test_slices_follow_bytes():
    import pyarrow as pa

    from lodestone.llm.common import slices

    texts = ["a" * 5, None, "b" * 30, "", "c" * 4, "d" * 4, "e"]
    parts = [x.column("text").to_pylist() for x in slices(pa.record_batch([pa.array(texts)], ["text"]), "text", rows=3, size=10)]
    assert sum(parts, []) == texts and [len(p) for p in parts] == [2, 1, 3, 1] and not list(slices(pa.record_batch([pa.array([], pa.string())], ["text"]), "text"))


def test_bpe_frames(docs, reference, spark, tmp_path):
    table, rows = docs
    ids = bpe.encode_texts(table, RANKS, public_tokenizers.PATTERN)
    found = bpe.decode_ids(ids, RANKS, public_tokenizers.PATTERN).collect()
    assert len(found) == len(rows)
    texts = {i: t or "" for i, t, *_ in rows}
    for r in found:
        assert r.ids == reference.encode_ordinary(texts[r.doc_id])
        assert bytes(r.decoded) == texts[r.doc_id].encode()
    none = bpe.encode_texts(empty(spark, tmp_path), RANKS, public_tokenizers.PATTERN)
    assert bpe.decode_ids(none, RANKS, public_tokenizers.PATTERN).count() == 0


def plain_best_fit(lengths, capacity):
    import bisect

    free, bins = [], 0
    for x in sorted(lengths, reverse=True):
        k = bisect.bisect_left(free, x)
        room = free.pop(k) if k < len(free) else capacity
        bins += room == capacity
        bisect.insort(free, room - x)
    return bins


def test_best_fit_on_histograms_is_best_fit():
    rnd = random.Random(4)
    for _ in range(60):
        capacity = rnd.choice([7, 16, 100, 1024])
        lengths = [rnd.randint(1, capacity) for _ in range(rnd.randint(0, 400))]
        histogram = {x: lengths.count(x) for x in set(lengths)}
        plan, bins = packing.best_fit(histogram, capacity)
        assert bins == plain_best_fit(lengths, capacity)
        places = defaultdict(list)
        for length, lo, hi, first, offset in plan:
            for k in range(hi - lo):
                places[first + k].append((offset, length))
        assert sum(hi - lo for _, lo, hi, _, _ in plan) == len(lengths)
        for own in places.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(places) == bins


def test_packing(docs, spark, tmp_path):
    table, rows = docs
    library = Tokenizer.from_file(JSON)
    library.encode_special_tokens = True
    wanted = defaultdict(list)
    for i, t, *_ in rows:
        wanted[i].append([*library.encode(t or "", add_special_tokens=False).ids, 2])
    found = packing.pack(table, JSON, public_tokenizers.PATTERN).collect()
    by, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(by) == set(wanted)
    for i, all_ids in wanted.items():
        ids = all_ids[0]
        pieces = sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in by[i]})
        at = 0
        for k, (piece, start, length, crc) in enumerate(pieces):
            part = ids[at : at + length]
            assert (piece, start, crc) == (k, at, zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
            assert k == 0 or length == 1024
            at += length
        assert at == len(ids)
        assert len(by[i]) == len(pieces) * len(all_ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert len(sequences) == plain_best_fit([r.length for r in found], 1024)
    assert packing.pack(empty(spark, tmp_path), JSON, public_tokenizers.PATTERN).count() == 0


def test_packing_gives_added_tokens_their_ids(spark):
    library = Tokenizer.from_file(JSON)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y", "<|endoftext", "é<|endoftext|>é  ", "plain <|endoftext |>"]
    encoder = packing.encoding(JSON, public_tokenizers.PATTERN)
    wanted = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert wanted[0] == [64, 220, 50256, 275]
    assert [encoder.encode(t, allowed_special="all") for t in texts] == wanted
    found = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), JSON, public_tokenizers.PATTERN).collect()
    assert {r.doc_id: (r.length, r.ids_crc32) for r in found} == {i: (len(x) + 1, zlib.crc32(struct.pack(f"<{len(x) + 1}I", *x, 2))) for i, x in enumerate(wanted)}


def test_mixture_finds_proportions():
    rnd = np.random.default_rng(5)
    chance = rnd.dirichlet(np.full(400, 0.05), 3) * 0.999 + 1e-6
    counts = rnd.multinomial(4000, (0.7 * chance[0] + 0.3 * chance[2]) / (0.7 * chance[0] + 0.3 * chance[2]).sum()).astype(float)
    mix = language_id.languages_of(chance, counts)
    assert set(mix) == {0, 2}
    assert abs(mix[0] - 0.7) < 0.05
    alone = rnd.multinomial(300, chance[1] / chance[1].sum()).astype(float)
    assert set(language_id.languages_of(chance, alone)) == {1}
    assert language_id.languages_of(chance, np.zeros(400)[:0]) == {}


def test_chosen_languages_are_the_best_subset():
    from itertools import combinations

    rnd = np.random.default_rng(11)
    for _ in range(40):
        k = int(rnd.integers(2, 6))
        chance = rnd.dirichlet(np.full(200, 0.1), k) * 0.99 + 5e-5
        own = rnd.choice(k, int(rnd.integers(1, 3)), replace=False)
        share = rnd.dirichlet(np.full(len(own), 4.0))
        p = share @ chance[own]
        counts = rnd.multinomial(1500, p / p.sum()).astype(float)
        price = language_id.PENALTY * np.log(counts.sum()) / 2
        subsets = [s for n in range(1, k + 1) for s in combinations(range(k), n)]
        best = max(subsets, key=lambda s: language_id.mixture(chance[list(s)], counts, 400)[1] - price * (len(s) - 1))
        assert set(language_id.languages_of(chance, counts)) == set(best)


def test_every_label_is_learnt(spark, tmp_path):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i % 7)} " * 30, f"l{i % 90:02}") for i in range(900)]
    path = str(tmp_path / "labels")
    spark.createDataFrame(rows, "doc_id int, text string, lang string").write.parquet(path)
    names, model = language_id.train(spark.read.parquet(path))
    assert names == [f"l{i:02}" for i in range(90)] and model.shape == (90, language_id.BINS)
    assert np.allclose(model.sum(1), 1, atol=1e-3)


def test_language_id_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names, model = language_id.train(docs.filter(~language_id.held_out("doc_id")))
    found = language_id.identify(docs, names, model).join(docs.select("doc_id", "lang", language_id.held_out("doc_id").alias("out")), "doc_id").filter("out").collect()
    assert sum(r.lang_pred == r.lang for r in found) >= 0.97 * len(found)
    assert all(0 <= r.score <= 1 for r in found)


def test_language_id_odd_cases(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names, model = language_id.train(docs)
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "e"), (None, "the of and the in to"), (5, "the of and " * 30000)]
    odd = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    found = {r.doc_id: r for r in language_id.identify(odd, names, model).collect()}
    assert [found[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3
    assert found[1].score == 0.0
    assert found[4].lang_pred in names
    assert found[5].lang_pred == "en"
    assert {r.doc_id for r in language_id.keep_known(odd, names, model).collect()} == {4, 5, None}
    assert language_id.train(empty(spark, tmp_path))[0] == []
    assert language_id.identify(odd, [], np.zeros((0, language_id.BINS))).filter("lang_pred = 'und'").count() == 6
    assert {r.doc_id for r in language_id.keep_known(odd, [], model[:0]).collect()} == {4, 5, None}


TEXTS = [
    (1, "Mr. John Smith and Mrs. Smith met Frau Müller; card 4111 1111 1111 1111 or 4111111111111111."),
    (2, "Write to a.B@Foo.com or A.b@foo.COM, call +1 (743) 555-3824 or +1 743 555 3824, ssn 123-45-6789"),
    (3, "host 10.1.2.3 and 8.8.8.8. key = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" DE89370400440532013000"),
    (4, None),
    (5, ""),
    (6, "Clean text with 12 numbers, 3.14 and a date 2024-01-01."),
    (7, "Госпожа Иванова wrote to Mr. John Smith, card 4111111111111111 and x@mail.example.com"),
    (8, "w" * 200000 + " bob@site.org"),
]


@pytest.fixture(scope="module")
def private(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pii") / "t")
    spark.createDataFrame([(i, t, 1) for i, t in TEXTS], "doc_id bigint, text string, canonical int").repartition(2).write.parquet(path)
    return spark.read.parquet(path)


def check_private(found):
    one, two, three, seven = (found[i].text for i in (1, 2, 3, 7))
    for secret in ("4111", "Smith", "Müller", "foo", "Foo", "555-3824", "123-45-6789", "8.8.8.8", "24be64", "DE8937", "Иванова", "bob@"):
        assert not any(secret in (r.text or "") for r in found.values()), secret
    cards = re.findall(r"card ([\d ]+\d)", one) + re.findall(r"or (\d{16})", one) + re.findall(r"card (\d+)", seven)
    assert len(cards) == 3 and len({c.replace(" ", "") for c in cards}) == 1
    digits = [int(c) for c in cards[1]][::-1]
    assert sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0
    mails = re.findall(r"\S+@[\w.]*\w", two)
    assert len(mails) == 2 and mails[0].lower() == mails[1].lower() and mails[0] != mails[1]
    assert re.search(r"[A-Z]", mails[0].split("@")[0][2])
    phones = re.findall(r"\+1[\d ()-]+\d", two)
    assert len({re.sub(r"\D", "", p) for p in phones}) == 1
    name = re.search(r"Mr\. (\w+ \w+) and Mrs\. (\w+)", one)
    assert name[1] in seven and name[1].split()[0] in pii.GIVEN["latin", "m"]
    assert re.search(r"Госпожа [А-Я][а-я]+ ", seven)
    assert three.startswith("host 10.") and re.search(r'"[0-9a-f]{40}"', three)
    iban = re.search(r"DE\d{20}", three)[0]
    assert int(iban[4:] + "1314" + iban[2:4]) % 97 == 1
    assert found[4].text is None and found[5].text == "" and found[6].text == TEXTS[5][1]
    assert found[6].n_entities == 0
    assert "@mail" not in seven and seven.endswith(".example.com")


def test_surrogates(private, spark, tmp_path):
    out = pii.replace_in(private)
    assert out.columns == ["doc_id", "text", "canonical", "n_entities", "entity_types"]
    check_private({r.doc_id: r for r in out.collect()})
    other = {r.doc_id: r.text for r in pii.replace_in(private, key="other").collect()}
    assert other[2] != {r.doc_id: r.text for r in out.collect()}[2]
    assert pii.replace_in(empty(spark, tmp_path)).count() == 0


def test_clashing_surrogates_are_drawn_again(private, monkeypatch):
    plain = pii._ipv4
    monkeypatch.setattr(pii, "_ipv4", lambda e, stream: pii.F.concat(pii.F.lit("9.9.9."), pii.F.pmod(pii._number(stream, pii.F.lit(0)), pii.F.lit(3)).cast("string")))
    spark = private.sparkSession
    path = f"{spark.sparkContext.getCheckpointDir()}/clash"
    spark.createDataFrame([(1, "1.1.1.1 2.2.2.2"), (2, "3.3.3.3 and 1.1.1.1")], "doc_id bigint, text string").write.mode("overwrite").parquet(path)
    found = {r.doc_id: r.text for r in pii.replace_in(spark.read.parquet(path)).collect()}
    a, b = found[1].split(" ")
    c, d = found[2].split(" and ")
    assert a == d and len({a, b, c}) == 3
    monkeypatch.setattr(pii, "_ipv4", plain)


def entities_of(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", pii.found_in("text").alias("found")).collect()
    return [r.found for r in sorted(rows, key=lambda r: r.i)]


def test_entities_directly_behind_letters(spark):
    key, iban = "0123456789abcdef" * 2, "DE89370400440532013000"
    cases = {
        "联系邮箱bob@site.org谢谢": "bob@site.org", "é.bob@site.org": ".bob@site.org", "jörg.meier@site.org": "rg.meier@site.org",
        "SSN123-45-6789": "123-45-6789", "nº123-45-6789": "123-45-6789", "é123-45-6789": "123-45-6789", "号123-45-6789": "123-45-6789",
        "电话+1 555 123 4567": "+1 555 123 4567", "é(555) 123-4567": "(555) 123-4567", "tel555-123-4567": "555-123-4567", "电555-123-4567": "555-123-4567",
        f"密钥{key}": key, f"é{key}": key, "钥" + "abcdef" * 6: "abcdef" * 6, f"号{iban}": iban, f"é{iban}": iban,
        "ip8.8.8.8": "8.8.8.8", "址8.8.8.8": "8.8.8.8", "卡4111111111111111": "4111111111111111", "card4111 1111 1111 1111": "4111 1111 1111 1111",
        "联系Mr. Smith": "Mr. Smith",
    }
    assert entities_of(spark, list(cases)) == [[x] for x in cases.values()]
    assert entities_of(spark, ["9123-45-6789", f"x{key}", "12.8.8.8.8.1"]) == [[], [], []]


def test_formats_of_phones_and_names(spark):
    phones = ["+33 6 12 34 56 78", "+81-3-1234-5678", "+61 2 9876 5432", "06 12 34 56 78", "06.12.34.56.78", "0612345678", "555 123 4567", "555.123.4567", "555-123-4567", "1-800-555-1234", "(555) 123-4567"]
    phones += ["+49 30 1234567", "030/1234567", "0171 1234567", "(030) 123456", "+44 (0)20 7946 0958", "020 7946 0958", "+34 612 345 678", "612 345 678", "612 34 56 78", "91 123 45 67", "+7 (495) 123-45-67"]
    names = ["Mr. J. Smith", "Herr Dr. Müller", "Mr John Ronald Smith", "Frau Prof. Dr. Anna Maria von der Heide", "Monsieur Jean-Pierre d'Artagnan", "Señora María de los Ángeles García López", "Dr. J.R.R. Tolkien", "Mr X"]
    texts = [f"a {x}, b" for x in phones + names]
    assert entities_of(spark, texts) == [[x] for x in phones + names]
    plain = ["on 01.02.2024 10:30 and 2024-01-02", "0.0612345678", "Mr said", "3 555 apples"]
    assert entities_of(spark, plain) == [[]] * len(plain)


def replaced(spark, path, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").write.mode("overwrite").parquet(path)
    return [r.text for r in sorted(pii.replace_in(spark.read.parquet(path)).collect(), key=lambda r: r.doc_id)]


def test_writings_of_one_entity_agree(spark, tmp_path):
    texts = ["+1 555 123 4567", "+15551234567", "+1 (555) 123-4567", "1-555-123-4567", "+44 (0)20 7946 0958", "+442079460958", "123-45-6789", "+12 345 6789", "DE89 3704 0044 0532 0130 00", "DE89370400440532013000"]
    out = replaced(spark, str(tmp_path / "w"), texts)
    digits = [re.sub(r"\D", "", x.replace("(0)", "")) for x in out]
    assert len(set(digits[:4])) == 1 and digits[0][0] == "1" and digits[0] != "15551234567"
    assert digits[4] == digits[5] and digits[4].startswith("44") and "(0)" in out[4]
    assert digits[6] != digits[7] and digits[8] == digits[9]
    keys = spark.createDataFrame([("123-45-6789",), ("+12 345 6789",)], "e string").select(pii.key_of(pii.F.col("e"))).collect()
    assert keys[0] != keys[1]


def test_a_crowded_address_range_is_assigned_by_rank(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pii, "DRAWS", 2)
    own = [f"192.168.{i // 200 + 1}.{i % 200 + 1}" for i in range(30000)]
    out = " ".join(replaced(spark, str(tmp_path / "c"), [" ".join(own[k : k + 1000]) for k in range(0, 30000, 1000)])).split()
    assert len(set(out)) == 30000 and not set(out) & set(own)
    assert all(x.startswith("192.168.") for x in out)


def test_names_end_and_full_formats_are_an_error(spark, monkeypatch):
    rows = [(1, "Dr House Party Rules Are Here Now For All"), (2, "Sra. María del Carmen García López Fernández dijo"), (3, "Mr John Smith Is Here")]
    texts = {r.doc_id: r.text for r in pii.replace_in(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert texts[1].endswith(" Now For All") and texts[1].startswith("Dr ") and not any(w in texts[1] for w in ("House", "Party", "Rules", "Are ", "Here"))
    assert texts[2].startswith("Sra. ") and " del " in texts[2] and texts[2].endswith(" dijo") and "Fernández" not in texts[2]
    # Every draw gives the same SSN, so the format is full for two of them.
    monkeypatch.setattr(pii, "LAST_DRAW", 2)
    monkeypatch.setattr(pii, "surrogate", lambda e, attempt, key: F.lit("912-34-5678"))
    two = spark.createDataFrame([(1, "123-45-6789 and 223-45-6789")], "doc_id bigint, text string")
    with pytest.raises(ValueError, match="ssn"):
        pii.replace_in(two).collect()


def test_rows_without_ids_are_sampled_for_training(spark):
    rows = [(None, f"the on thing number {i} " * 3, "en") for i in range(400)] + [(i, f"der und das {i}", "de") for i in range(400)]
    labelled = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    names, model = language_id.train(labelled, per_language=20)
    assert names == ["de", "en"] and model.shape[0] == 2
    # What was counted is about twenty texts of each language, not all that lack an id.
    share = labelled.filter("lang = 'en'").filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(20 / 400 * (1 << 30))).count()
    assert 5 <= share <= 50


def test_words_of_names_agree(spark, tmp_path):
    texts = ["Mr Smith", "Mr. Smith", "Herr John Smith", "Mr John Smith", "Mr. J. Smith", "Mr. K. Smith", "Frau SMITH", "Monsieur von Smith", "Mrs Anna Braun", "Dr. Anna Braun", "Señora d'Arc", "Mr John Paul Smith", "Господин Иван Петров", "Κύριος Νίκος Παπάς"]
    out = replaced(spark, str(tmp_path / "n"), texts)
    family = out[0].removeprefix("Mr ")
    assert family not in ("Smith", "") and out[1] == f"Mr. {family}"
    given = out[3].split()[1]
    assert out[2] == f"Herr {given} {family}" and out[3] == f"Mr {given} {family}" and given.split("-")[0] in pii.GIVEN["latin", "m"]
    assert re.fullmatch(rf"Mr\. [A-Z]\. {family}", out[4]) and re.fullmatch(rf"Mr\. [A-Z]\. {family}", out[5]) and out[4] != out[5] and out[4] != texts[4]
    assert out[6] == f"Frau {family.upper()}" and out[7] == f"Monsieur von {family}"
    assert out[8].split()[1].split("-")[0] in pii.GIVEN["latin", "f"] and out[8].split()[-1] == out[9].split()[-1] != family
    assert out[10].startswith("Señora d'") and "Arc" not in out[10] and out[11].split()[1] == given
    assert out[12].split()[1].split("-")[0] in pii.GIVEN["cyrillic", "m"] and out[13].split()[1].split("-")[0] in pii.GIVEN["greek", "m"]


def test_secrets_of_any_length(spark, tmp_path):
    key = "-----BEGIN RSA PRIVATE KEY-----\n" + "Ab1+/" * 700 + "\n-----END RSA PRIVATE KEY-----"
    texts = ["ghp_" + "a1B2" * 9, "github_pat_" + "x9_" * 10, "xoxb-123456789012-abcdefABCDEF", "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl", "sk-" + "Zz9" * 50, "0f" * 3000, "0F" * 100, key]
    assert entities_of(spark, texts) == [[x] for x in texts]
    out = replaced(spark, str(tmp_path / "k"), texts)
    for a, b in zip(texts, out, strict=True):
        assert a != b and len(a) == len(b)
    assert out[0].startswith("ghp_") and out[1].startswith("github_pat_") and out[2].startswith("xoxb-") and re.fullmatch("[0-9a-f]{6000}", out[5]) and re.fullmatch("[0-9A-F]{200}", out[6])
    assert out[7].startswith("-----BEGIN RSA PRIVATE KEY-----\n") and out[7].endswith("\n-----END RSA PRIVATE KEY-----") and "Ab1+/Ab1+/" not in out[7]


def test_repeated_rows_and_clashing_columns(spark, tmp_path):
    rows = [(7, "call +1 555 123 4567", 5, ["x"]), (7, "call +1 555 123 4567", 5, ["x"]), (None, "bob@site.org", 1, None), (8, None, None, None)]
    path = str(tmp_path / "r")
    spark.createDataFrame(rows, "doc_id int, text string, n_entities int, _found array<string>").write.parquet(path)
    out = pii.replace_in(spark.read.parquet(path))
    assert out.columns == ["doc_id", "text", "_found", "n_entities", "entity_types"]
    found = out.collect()
    same = [r.text for r in found if r.doc_id == 7]
    assert len(found) == 4 and len(same) == 2 and same[0] == same[1] != rows[0][1]
    assert sorted(r.n_entities for r in found) == [0, 1, 1, 1] and [r._found for r in found if r.doc_id == 7] == [["x"]] * 2
