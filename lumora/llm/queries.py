"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from lumora.llm.ann import op10_ann_graph
from lumora.llm.bwtmerge import op13_merged_bwt
from lumora.llm.langid import op4_language_id
from lumora.llm.licenses import op2_license_scan
from lumora.llm.mixing import op6_mix_sources
from lumora.llm.packing import op1_pack_lengths
from lumora.llm.periodic import op12_periodic_runs
from lumora.llm.pii import op5_personal_data
from lumora.llm.rabitq import op8_embedding_near_dedup
from lumora.llm.simhash import op9_simhash_near_dedup
from lumora.llm.sortmeans import op11_sort_means
from lumora.llm.styletree import op7_main_text
from lumora.llm.urls import op3_url_filter
from lumora.llm import licenses, sortmeans, urls

QUERIES = {
    "op2_license_scan": op2_license_scan,
    "op7_main_text": op7_main_text,
    "op10_ann_graph": op10_ann_graph,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op5_personal_data": op5_personal_data,
    "op4_language_id": op4_language_id,
    "op3_url_filter": op3_url_filter,
    "op1_pack_lengths": op1_pack_lengths,
    "op6_mix_sources": op6_mix_sources,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op11_sort_means": op11_sort_means,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_merged_bwt": op13_merged_bwt,
}

ORACLES: dict[str, str] = {"op2_license_scan": licenses.oracle(), "op3_url_filter": urls.oracle(), "op11_sort_means": sortmeans.oracle()}
