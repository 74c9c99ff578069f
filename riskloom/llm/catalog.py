"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from riskloom.llm.decontamination import OP10_SQL, op10_minhash_containment
from riskloom.llm.extraction import op7_recurrent_extraction
from riskloom.llm.languages import op11_word_backoff
from riskloom.llm.licenses import op8_license_classifier
from riskloom.llm.manifest import OP12_SQL, op12_van_emde_boas_manifest
from riskloom.llm.mixing import op9_soft_mixing
from riskloom.llm.negatives import OP13_SQL, op13_bit_plane_negatives
from riskloom.llm.ngram_join import op1_ngram_jaccard_join
from riskloom.llm.paragraphs import op2_paragraph_minhash
from riskloom.llm.quality import op6_suffix_repetition
from riskloom.llm.secrets import op5_blob_ledger_secrets
from riskloom.llm.sharding import OP3_SQL, op3_rendezvous_sharding
from riskloom.llm.substrings import op4_lyndon_suffix_dedup

QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_paragraph_minhash,
        op3_rendezvous_sharding,
        op4_lyndon_suffix_dedup,
        op5_blob_ledger_secrets,
        op6_suffix_repetition,
        op7_recurrent_extraction,
        op8_license_classifier,
        op9_soft_mixing,
        op10_minhash_containment,
        op11_word_backoff,
        op12_van_emde_boas_manifest,
        op13_bit_plane_negatives,
    )
}
ORACLES = {
    "op3_rendezvous_sharding": OP3_SQL,
    "op10_minhash_containment": OP10_SQL,
    "op12_van_emde_boas_manifest": OP12_SQL,
    "op13_bit_plane_negatives": OP13_SQL,
}
