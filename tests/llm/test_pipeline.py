import hashlib
import re
from collections import Counter

from tokenizers import Tokenizer

import corpus_pipeline as P
from threatlens.llm import secret_scan, toxicity
from threatlens.llm.queries import BYTE_RANKS, WORD_BPE, fitted_lexicon

from .conftest import SF, documents
from .test_mixture import brute as brute_mix
from .test_secret_scan import base
from .test_simhash_dedup import brute as brute_groups


def test_run_matches_brute_force(spark):
    lexicon = fitted_lexicon(documents(spark), documents(spark, "labels"))
    m = toxicity.Matcher(lexicon)
    docs = [r for r in documents(spark).orderBy("doc_id").collect()]
    kept = [r for r in docs if m.score(*m.evidence(r.text)[:2]) < 0.7]
    group = {d: c for d, _, c in brute_groups([(r.doc_id, r.text) for r in kept])}
    kept = [r for r in kept if group[str(r.doc_id)] == str(r.doc_id)]
    scanner, clean = secret_scan.Scanner(BYTE_RANKS), []
    for r in kept:
        text, at, parts = r.text, 0, []
        spans = sorted({*base(text), *scanner.find(text)}, key=lambda x: (x[1], x[2]))
        hidden = "".join("\0" if any(a <= i < b for _, a, b in spans) else c for i, c in enumerate(text)) if spans else text
        clean.append((r.doc_id, re.sub("\0+", "[SECRET]", hidden), r.source))
    mix = brute_mix(clean)
    lib = Tokenizer.from_file(WORD_BPE)
    want = Counter()
    for i, (d, t, s) in enumerate(clean):
        times = mix[i][3] // mix[i][0] if mix[i][0] else 0
        ids = lib.encode(t, add_special_tokens=False).ids
        digest = hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
        want[d, len(ids), digest, hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += times
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in P.run(spark, SF).collect())
    assert got == +want


def test_stages_return_the_columns_of_their_input(spark, hazards, no_rows):
    for docs in (hazards, no_rows):
        for name, stage in P.STAGES:
            out = stage(spark, docs, SF)
            if name != "bpe":
                assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            n = out.count()
            assert n == 0 if docs is no_rows else n > 0
    assert len(P.STAGES) == 5 and P.ORACLE_SQL is None


def test_clean_documents_pass_the_filters(spark):
    labels = {r.doc_id: r for r in documents(spark, "labels").collect()}
    kept = {r.doc_id for r in P.drop_toxic(spark, documents(spark), SF).collect()}
    clean = {d for d, r in labels.items() if r.toxic == 0}
    assert len(clean - kept) <= 0.02 * len(clean)
    assert P.redact_secrets(spark, documents(spark), SF).count() == documents(spark).count()
