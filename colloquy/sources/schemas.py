"""Explicit schemas of the sources, in DDL."""

from __future__ import annotations

TURNS_A = "conv_id bigint, turn_id bigint, question string, answers array<string>, positive_ctxs array<struct<passage_id:string,title:string,text:string>>"
TURNS_B = "Conversation_no bigint, Turn_no bigint, Question string, Answer string, Truth_answer string, Rewrite string, Truth_rewrite string, Context array<string>, Conversation_source string, Passages array<string>, Truth_passages array<string>"
PASSAGES_TSV = "id string, text string, title string"
PASSAGES_JSON = "id string, contents string, text string, raw_passage_id string, title string"
LABELS = (
    "sample_id string, split string, conv_id bigint, turn_id bigint, history_len int, current_query string, "
    "spans array<struct<span_id:int,turn_id:int,field:string,label:string,text:string,char_start:int,char_end:int,reason:string>>, "
    "invalid_spans array<struct<turn_id:int,field:string,label:string,text:string,error:string>>, teacher_metadata struct<model:string,prompt_tokens:int,completion_tokens:int,total_tokens:int>"
)
TOKEN_SCORES = "sample_id string, gold_passage_id string, tokens array<struct<turn_id:int,field:string,start:int,end:int,text:string,score_raw:double,score_norm:double>>"
SELECTED_HISTORIES = "sample_id string, history array<struct<turn_id:int,question:string,answer:string>>"
RANKINGS = "query_id string, docids array<string>"
HITS = "query_id string, rank int, docid string, score double"
QUERY_BUNDLE = "family string, system string, sample_id string, budget int, view string, query string"
