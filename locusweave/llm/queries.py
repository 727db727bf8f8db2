"""One registered query per operator, each over its whole table."""

import public_tokenizers

from locusweave.llm import bpe, decontaminate, language_id, pii, prefix_trie, qda, quality_rules, secrets, simhash, token_files, toxicity, url_filters, vector_codes
from locusweave.llm.registry import query, table


@query("op1_simhash_dedup")
def op1(spark, d):
    return simhash.near_duplicates(table(spark, d, "documents"), shingle=4, radius=2)


@query("op2_url_filters", url_filters.SQL)
def op2(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    return url_filters.url_verdicts(url_filters.captures_of(pages), url_filters.edits_of(pages))


@query("op3_quality_rules")
def op3(spark, d):
    return quality_rules.quality_rules(table(spark, d, "documents"))


@query("op8_quality_classifier")
def op8(spark, d):
    return qda.quality_scores(table(spark, d, "documents"), table(spark, d, "labels"))


@query("op9_secret_scans")
def op9(spark, d):
    return secrets.secret_spans(table(spark, d, "documents")).drop("live_spans", "digest")


@query("op4_toxicity")
def op4(spark, d):
    return toxicity.toxicity_scores(table(spark, d, "documents"), table(spark, d, "labels"))


@query("op6_byte_level_bpe")
def op6(spark, d):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(table(spark, d, "documents"), path, public_tokenizers.PATTERN, most=300_000)


@query("op5_rans_token_files")
def op5(spark, d):
    folder = token_files.new_folder(spark)
    token_files.write(table(spark, d, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_files.read(spark, folder)


@query("op7_decontamination")
def op7(spark, d):
    return decontaminate.leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query("op10_pii")
def op10(spark, d):
    return pii.pii_spans(table(spark, d, "documents")).drop("all_spans", "digest")


@query("op11_vector_codes", vector_codes.SQL)
def op11(spark, d):
    return vector_codes.vector_codes(table(spark, d, "embeddings"))


@query("op13_prefix_trie", prefix_trie.SQL)
def op13(spark, d):
    return prefix_trie.trie_nodes(table(spark, d, "conversations"))


@query("op12_language_id")
def op12(spark, d):
    return language_id.languages(table(spark, d, "documents"))
