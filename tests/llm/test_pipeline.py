import numpy as np
import public_tokenizers
import pyarrow as pa

import corpus_pipeline
from outlast.llm import langid, quality

from .conftest import SF
from .test_neardup import components
from .test_packing import check_pieces


def test_run_equals_brute_force(llm, documents):
    """The learned models applied row by row, all pairs for near-copies, and packed sequences without loss."""
    from tokenizers import Tokenizer

    labels = llm.read.parquet(f"{SF}/labels.parquet")
    net = langid.fit_languages(documents)
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    kept = [(i, t) for i, t in rows for names, scores in [langid.predict_batch(net, pa.array([t or ""]))]
            if names[0] != "und" and scores[0] >= 0.4]
    assert 0 < len(kept) <= len(rows)
    model = quality.fit_quality(documents.where(documents.doc_id.isin([i for i, _ in kept])), labels)
    kept = [(i, t) for i, t in kept if quality.score_batch(model, pa.array([t]))[0] >= 0.7]
    groups = components(kept, size=5)
    kept = [(i, t) for i, t in kept if groups[i][1] == i]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = [(i, tokenizer.encode(t, add_special_tokens=False).ids + [2]) for i, t in kept]
    check_pieces(corpus_pipeline.run(llm, SF).collect(), expected, 4096)


def test_stages_keep_columns_and_take_empty_tables(llm, no_documents, odd_documents):
    docs = odd_documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(llm, docs, SF)
        assert kept.columns == docs.columns, name
        assert stage(llm, no_documents, SF).collect() == []
    assert corpus_pipeline.STAGES[-1][1](llm, no_documents, SF).collect() == []
    assert np.all([len(s) == 2 for s in corpus_pipeline.STAGES])
