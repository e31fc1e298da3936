"""Explicit schemas of the stored tables and file formats."""

from __future__ import annotations

VECTOR = "array<double>"
FRAME = "stream_id string, frame_idx long, ts double, payload binary"
WINDOW = f"stream_id string, window_ord long, window_id string, start_time double, end_time double, visual_embedding {VECTOR}, summary_text string, summary_embedding {VECTOR}, frame binary, tier string"
EPISODE = f"stream_id string, episode_ord long, episode_id string, start_time double, end_time double, visual_embedding {VECTOR}, member_window_ids array<string>, representative_window_ids array<string>, summary_text string, summary_embedding {VECTOR}"
EVENT = f"stream_id string, event_ord long, event_id string, start_time double, end_time double, visual_embedding {VECTOR}, member_episode_ids array<string>, representative_window_ids array<string>, summary_text string, summary_embedding {VECTOR}"
HIT = "stream_id string, question_id string, stage string, rank int, entry_id string, score double"
QA = "question_id string, task_type string, question string, time_stamp string, answer string, options array<string>"
QA_FILE = f"sample_id int, video string, qas array<struct<question_id:string,task_type:string,question:string,time_stamp:string,answer:string,options:array<string>>>"
QA_LINES = "uid string, question string, question_type array<string>, time_reference string, time_stamp string, answer string, options array<string>"
SYSTEM = "struct<prediction:string,pred_letter:string,ground_truth:string,correct:boolean>"
RECORD = f"question_id string, task_type string, question string, time_stamp string, t_seconds double, stream_time double, options array<string>, hierarchical {SYSTEM}, baseline {SYSTEM}"
MANIFEST = "sample_id int, video_key string, video string, qas string, n_qas int, type string, duration_minutes double"
TIERS = ("recent", "episodic")
