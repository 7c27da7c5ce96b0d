import hashlib
from collections import Counter

import public_tokenizers as P
import pytest

from quarry.llm import align

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    return tok, sentencepiece.SentencePieceProcessor(model_file=B), align.byte_level_tokens(A), align.piece_tokens(B)


def brute(rows, tokenizers):
    """Every pair of tokens of a text compared by its byte ranges."""
    tok, model, bytes_a, bytes_b = tokenizers
    links, docs = Counter(), []
    for doc_id, text in rows:
        raw = " " + (text or "")
        a, b = tok.encode(raw, add_special_tokens=False).ids, model.encode(text or "")
        joined = (b"".join(bytes_a[i] for i in a), b"".join(bytes_b[i] for i in b))
        if not text or joined != (raw.encode(), raw.encode()):
            docs.append((doc_id, [], [], [], []))
            continue
        spans = []
        for ids, tokens in ((a, bytes_a), (b, bytes_b)):
            at, out = 0, []
            for i in ids:
                out.append((at, at + len(tokens[i])))
                at += len(tokens[i])
            spans.append(out)
        pairs = [(x, y) for x, s in zip(a, spans[0]) for y, t in zip(b, spans[1]) if max(s[0], t[0]) < min(s[1], t[1])]
        links.update(pairs)
        cuts = sorted({s[1] for s in spans[0]} & {s[1] for s in spans[1]})
        groups, low = [], 0
        for cut in cuts:
            groups.append(tuple([i for i, s in zip(ids, of) if low <= s[0] and s[1] <= cut] for ids, of in zip((a, b), spans)))
            low = cut
        docs.append((doc_id, a, b, pairs, groups))
    best = Counter()
    for (_, y), n in links.items():
        best[y] = max(best[y], n)
    out = []
    for doc_id, a, b, pairs, groups in docs:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, len(a), len(b), len(groups), len(pairs), sum(links[p] == best[p[1]] for p in pairs),
                    sum(links[p] for p in pairs), text))
    return out


def key(r):
    return tuple((x is None, x) for x in r)


def rows_of(prose):
    rows = [(i, prose(i % 30)) for i in range(60)]
    rows += [(100 + i, t) for i, t in enumerate([
        None, "", " ", "a", "  two  blanks ", "line\n\nline\r\n\ttab", "日本語 text é ß", "it's <|endoftext|> 'll 123 <s> </s> <unk> <0x41>",
        "🙂🙂 antidisestablishmentarianism", "under▁score", "nul\x00 byte", "ﬁ Á é", "1234567890 " * 5, "aaaaaaaaaaaaaaaaaaaaa"])]
    return rows + [(None, "no id here"), (None, "no id here"), (3, "again"), (3, prose(12))]


def test_equals_brute_force(documents, prose, tokenizers):
    rows = rows_of(prose)
    got = sorted((tuple(r) for r in align.align(documents(rows), A, B).collect()), key=key)
    assert got == sorted(brute(rows, tokenizers), key=key)
    assert {r[1] for r in got if r[0] in (100, 101, 109)} == {0}  # null, empty, not restored


def test_small_blocks(documents, prose, tokenizers):
    """Counts add up over blocks and tasks, and blocks cut by the reader."""
    rows = rows_of(prose) * 3
    docs = documents(rows).repartition(7)
    got = sorted((tuple(r) for r in align.align(docs, A, B).collect()), key=key)
    assert got == sorted(brute(rows, tokenizers), key=key)


def test_identity_map(tokenizers):
    a, b = tokenizers[2:]
    same = align.identity_map(a, b)
    assert all(b[y] == a[x] for x, y in enumerate(same) if y >= 0) and (same >= 0).sum() > 10_000


def test_vocabularies_restore_bytes(tokenizers):
    tok, model, a, b = tokenizers
    text = " It's 12 naïve\n\tcafés — 日本語 🙂"
    assert b"".join(a[i] for i in tok.encode(text, add_special_tokens=False).ids) == text.encode()
    assert b"".join(b[i] for i in model.encode(text[1:])) == text.encode()


def test_empty_tables_and_long_text(documents):
    assert align.align(documents([]), A, B).collect() == []
    assert [tuple(r) for r in align.align(documents([(1, None)]), A, B).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    [row] = align.align(documents([(1, long)]), A, B).collect()
    assert row.n_a > 60_000 and row.n_groups == len(row.groups.split(";")) and row.n_best <= row.n_links


def test_registered_query(spark, tmp_path, documents, prose, tokenizers):
    from quarry.llm import queries

    rows = rows_of(prose)
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.queries()["op13_align"](spark, str(tmp_path)).collect()
    want = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in brute(rows, tokenizers)]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
