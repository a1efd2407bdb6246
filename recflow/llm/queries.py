"""The registered queries of this subpackage: each takes (spark, folder of tables)."""

from __future__ import annotations

from . import p1_entities, p10_sentences, p2_overlap, p3_neighbors, p4_truncation, p5_splits, p6_pairs, p7_conversations, p8_tokens, p9_packing
from .common import table

QUERIES = {
    "p1_found": lambda s, d: p1_entities.found(table(s, d, "source_records"), table(s, d, "tracks")),
    "p1_matches": lambda s, d: p1_entities.matches(table(s, d, "source_records"), table(s, d, "tracks")),
    "p1_one_to_one": lambda s, d: p1_entities.one_to_one(p1_entities.scored_pairs(table(s, d, "source_records"), table(s, d, "tracks"))),
    "p2_found": lambda s, d: p2_overlap.overlap_pairs(table(s, d, "train_pairs")),
    "p2_report": lambda s, d: p2_overlap.overlap_report(table(s, d, "train_pairs")),
    "p3_found": lambda s, d: p3_neighbors.close_pairs(table(s, d, "track_vectors")),
    "p3_neighbors": lambda s, d: p3_neighbors.nearest(table(s, d, "track_vectors")),
    "p4_found": lambda s, d: p4_truncation.truncated_values(table(s, d, "track_crawl")),
    "p4_rates": lambda s, d: p4_truncation.truncation_rates(table(s, d, "track_crawl")),
    "p4_spikes": lambda s, d: p4_truncation.spikes_of(table(s, d, "track_crawl")),
    "p5_assign": lambda s, d: p5_splits.assign_splits(table(s, d, "train_pairs"), table(s, d, "sessions")),
    "p5_report": lambda s, d: p5_splits.split_report(p5_splits.assign_splits(table(s, d, "train_pairs"), table(s, d, "sessions"))),
    "p6_found": lambda s, d: p6_pairs.first_defects(table(s, d, "messages")),
    "p6_defects": lambda s, d: p6_pairs.defects(table(s, d, "messages")),
    "p7_found": lambda s, d: p7_conversations.dropped_sessions(table(s, d, "messages")),
    "p7_conversations": lambda s, d: p7_conversations.conversations(table(s, d, "messages")),
    "p8_ids": lambda s, d: p8_tokens.token_ids(table(s, d, "documents")),
    "p9_containers": lambda s, d: p9_packing.fill_containers(table(s, d, "documents")),
    "p9_report": lambda s, d: p9_packing.fill_report(p9_packing.fill_containers(table(s, d, "documents"))),
    "p10_found": lambda s, d: p10_sentences.sentences(table(s, d, "documents"), texts=False),
    "p10_sentences": lambda s, d: p10_sentences.sentences(table(s, d, "documents")),
}
