"""The queries of this subpackage and the SQL that must give the same rows."""

from bitext_engine.llm import conversation_repair, embeddings, fingerprints, licenses, minhash, mixing, neighbours, packing, preference, quality, suffix, token_alignment, token_files

QUERIES = {
    "op1_fingerprints": fingerprints.query,
    "op2_token_files": token_files.query,
    "op3_embeddings": embeddings.query,
    "op4_licenses": licenses.query,
    "op5_packing": packing.query,
    "op6_minhash": minhash.query,
    "op7_quality": quality.query,
    "op8_preference": preference.query,
    "op9_mixing": mixing.query,
    "op10_suffix": suffix.query,
    "op11_conversation_repair": conversation_repair.query,
    "op12_token_alignment": token_alignment.query,
    "op13_neighbours": neighbours.query,
}
SQL = {
    "op1_fingerprints": fingerprints.SQL,
    "op3_embeddings": embeddings.SQL,
    "op6_minhash": minhash.SQL,
    "op8_preference": preference.SQL,
    "op9_mixing": mixing.SQL,
    "op10_suffix": suffix.SQL,
    "op11_conversation_repair": conversation_repair.SQL,
}
