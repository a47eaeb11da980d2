"""Declared schemas: JSON lines are never inferred."""

from __future__ import annotations

STATUTE = "act_id string, act_name string, section string, title string, text string, chapter string, subsection string, effective_date string, replaces string, punishment_summary string, tags array<string>, source_url string"
MAPPING = "old_act string, old_section string, new_act string, new_section string, note string"
MESSAGES = "array<struct<role: string, content: string>>"
RAG = "struct<k: int, context_keys: array<string>, gold_injected: boolean, is_miss: boolean, question: string>"
METADATA = f"struct<language: string, legal_domain: string, task_type: string, source_act: string, source_sections: array<string>, generator: string, verified: boolean, dataset_version: string, rag: {RAG}, run_id: string, sample_id: int, split: string, subtype: string, distractors: int>"
TRAINING = f"id string, messages {MESSAGES}, metadata {METADATA}"
EVAL = "id string, question string, language string, legal_domain string, task_type string, expected_answer string, required_facts array<string>, forbidden_facts array<string>, difficulty string, source string, split string"
EVAL_CURATED = EVAL + ", quarantined_facts array<struct<fact: string, gold_score: double, reason: string, lint: array<string>>>, forbidden_needs_rewrite array<struct<fact: string, lint: array<string>, fires_on_gold: boolean>>, needs_curation boolean, source_eval string, visibility string"
PREDICTION = "id string, question string, response string, retrieved array<string>, gold_sections array<string>, gold_in_context boolean, latency_s double"
PREDICTION_CURATED = f"{PREDICTION}, record struct<{', '.join(f.replace(' ', ': ', 1) for f in EVAL.split(', '))}>"
TASK = "task_id string, task_type string, language string, source_act string, source_sections array<string>, prompt string"
RAFT_TASK = TASK + ", orig_id string, user_prompt string, question string, context_keys array<string>, is_miss boolean, split string, sample_id int, run_id string"
REJECT = "run_id string, task_id string, split string, reason string, raw string, answer string"
PAIR = f"prompt {MESSAGES}, chosen string, rejected string, reject_reason string, task_id string"
ASSET = "asset_id string, url string, sha256 string, bytes bigint, fetched_at string"
OBJECT = "key string, size bigint"
SCORE_CACHE = "pair_key string, model_score double"
MCQ = "question string, option_a string, option_b string, option_c string, option_d string, correct_answer string, language string, subject_domain string"
CASE = "case_id string, name string, citation string, year int, court string, topics array<string>, why_landmark string"
ALIAS = "family string, variant string, pattern string"
SYNONYM = "ord int, phrase string, expansion string, version string"
"""A synonym table keeps all versions; a run picks one."""
