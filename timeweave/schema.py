"""Declared schemas of files and tables."""

from __future__ import annotations

CONVERSATION = (
    "sample_id string, conversation string, "
    "qa array<struct<question:string,answer:string,category:int,evidence:array<string>>>"
)
HAYSTACK_MESSAGE = "struct<role:string,content:string,text:string,time:string,timestamp:string>"
HAYSTACK = (
    "question_id string, question_type string, question string, question_date string, answer string, answer_session_ids array<string>, "
    f"haystack_dates array<string>, haystack_session_ids array<string>, haystack_sessions array<array<{HAYSTACK_MESSAGE}>>"
)
EVENT = (
    "struct<event_id:string,description:string,event_temporal_type:string,"
    "time_metadata:struct<observedTime:string,startTime:string,endTime:string,granularity:string>>"
)
BLOCK_FILE = (
    "user_id string, block_id bigint, box_id bigint, coverage struct<session_id:string,start_idx:int,end_idx:int>, "
    "temporal_index struct<sessionstart_time:string,sessionend_time:string,block_event_start_time:string,block_event_end_time:string>, "
    f"features struct<content_text:string,topic_kw_text:string,categories:array<string>>, events_count int, events array<{EVENT}>"
)
TRACE = "user_id string, metric string, box_ids array<bigint>, entries array<struct<start_time:string,events:array<string>>>"
VECTOR_FILE = "user_id string, data map<string,map<string,array<float>>>"
RELATIONS = (
    "user_id string, relation_id string, source string, relationship string, destination string, event_id string, "
    "block_id string, block_key string, event_ts timestamp"
)
