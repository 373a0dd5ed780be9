"""op12 against a plain version by the libraries themselves, with sets of ends and all pairs of tokens."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from memlake.llm import alignment, queries

SF = "/root/testdata/sf0.001"
ODD = ["", None, " ", "   ", " a", "a ", "a  b   c", "\t\n x\r\n", "ﬁ①é é", "a▁b", "<|endoftext|> and <s> <unk> <0x41>", "\x00a", "one.\nTwo \n\n three\n", "\nx", "日本語のテキスト", "😀😀 ok", "x" * 3_000, "qzx" * 2_000, "word " * 20_000, " 　 y"]


def plain(rows):
    byte = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    byte.encode_special_tokens = True
    piece = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    plain_bytes = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in plain_bytes} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain_bytes)}
    out, pairs = [], []
    for i, text in rows:
        a = byte.encode(" " + (text or ""), add_special_tokens=False).ids
        b = piece.encode(text or "")
        bytes_a = [bytes(back[c] for c in byte.id_to_token(t)) for t in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if piece.is_byte(t) else p.replace("▁", " ").encode() for t in b for p in [piece.id_to_piece(t)]]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            out.append((i, 0, 0, 0, 0, ""))
            pairs.append(Counter())
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        found = {e: ([], []) for e in sorted(set(ends_a) & set(ends_b))}
        bounds = np.array(list(found))
        for side, (ids, ends) in enumerate(((a, ends_a), (b, ends_b))):
            for t, e in zip(ids, ends):
                found[int(bounds[np.searchsorted(bounds, e)])][side].append(t)
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in found.values())
        links = Counter((x, y) for g in found.values() for x in g[0] for y in g[1])
        out.append((i, len(a), len(b), len(found), links.total(), hashlib.sha256(written.encode()).hexdigest()))
        pairs.append(links)
    docs = Counter(p for links in pairs for p in links)
    most = defaultdict(int)
    for (x, _), n in docs.items():
        most[x] = max(most[x], n)
    return Counter((i, na, nb, ng, nl, sum(n for p, n in links.items() if docs[p] == most[p[0]]), sum(n * docs[p] for p, n in links.items()), d) for (i, na, nb, ng, nl, d), links in zip(out, pairs))


def test_query_equals_the_libraries(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert Counter(map(tuple, queries.op12_alignment(spark, SF).collect())) == plain(rows)


def test_odd_texts_with_and_without_a_head(spark):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, "no id"), (1, "repeated id"), (4, " a")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_a int, row string")
    expected = plain(rows)
    for head in (alignment.HEAD_PAIRS, 5, 0):
        assert Counter(map(tuple, alignment.cross_tokens(docs, head_pairs=head).collect())) == expected
    assert alignment.cross_tokens(docs.limit(0)).collect() == []


def test_written_groups(spark):
    row = alignment.aligned(spark.createDataFrame([(1, "Hello, world")], "doc_id long, text string"), written=True).first()
    assert row.groups_sha256 == hashlib.sha256(row.groups.encode()).hexdigest() and len(row.groups.split(";")) == row.n_groups
    assert sum(row.n) == row.n_links


def test_groups_equal_common_ends():
    rng = random.Random(3)
    for trial in range(400):
        n = rng.choice([1, 2, 5, 40, 300])
        a, b = ({*rng.sample(range(1, n + 1), rng.randint(0, n)), n} for _ in "ab")
        if trial % 2:
            b = {n} | {x for x in a if rng.random() < 0.95}
        a, b = sorted(a), sorted(b)
        common = sorted(set(a) & set(b))
        ends = alignment.groups(np.array(a), np.array(b))
        assert [e.tolist() for e in ends] == [[a.index(c) + 1 for c in common], [b.index(c) + 1 for c in common]]


def test_links_of_a_dense_group_are_counted_by_ids():
    a, b = np.array([7] * 100 + [8] * 3), np.array([1] * 90 + [2] * 5)
    keys, n = alignment.links(a, b, np.array([101, 103]), np.array([93, 95]))
    assert dict(zip([divmod(k, alignment.SPAN) for k in keys.tolist()], n.tolist())) == {(7, 1): 9000, (7, 2): 300, (8, 1): 90, (8, 2): 3 + 4}
