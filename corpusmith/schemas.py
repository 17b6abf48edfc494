"""Explicit schemas of the data model; sources never infer."""

TITLES = "title STRING, pageid BIGINT"
PAGES = "title STRING, pageid BIGINT, revisions ARRAY<STRUCT<slots: STRUCT<main: STRUCT<content: STRING>>>>"
#: Success and error records in one: an error has only title and error.
HTML_RECORDS = "title STRING, pageid BIGINT, html STRING, wikitext STRING, error STRING"
ARTICLES = (
    "title STRING, pageid BIGINT, game STRING, games ARRAY<STRING>, url STRING, "
    "infoboxes ARRAY<STRUCT<template: STRING, fields: ARRAY<STRUCT<k: STRING, v: STRING>>>>, "
    "factblocks ARRAY<STRUCT<heading: STRING, lines: ARRAY<STRING>>>, "
    "sections ARRAY<STRUCT<heading: STRING, text: STRING>>"
)
CHUNKS = "chunk_id STRING, pageid BIGINT, title STRING, game STRING, games ARRAY<STRING>, heading STRING, url STRING, text STRING"
VECTORS = f"{CHUNKS}, embedding ARRAY<FLOAT>"
GOLD = "id STRING, game STRING, category STRING, question STRING, answer STRING, source_url STRING, source_title STRING"
REQUESTS = "question STRING, game STRING, history ARRAY<STRUCT<question: STRING, answer: STRING>>"
VERDICT = "STRUCT<verdict: STRING, confidence: DOUBLE>"
GATES = (
    "kind STRING, question STRING, previous_question STRING, game STRING, tier STRING, topic STRUCT<choice: STRING, confidence: DOUBLE>, "
    f"format STRUCT<choice: STRING, confidence: DOUBLE>, check1 {VERDICT}, check2 {VERDICT}, ms DOUBLE"
)
EVENTS = "qid STRING, seq INT, kind STRING, payload STRING"
