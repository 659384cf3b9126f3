"""All queries of the library proper, by name, and their DuckDB SQL."""

from __future__ import annotations

from helixframe.operators import acmg, alignment, annotation, cards, cjk_search, consensus, evaluation, genotype, intervals, kinship, names, ontology, phrases, records, resolve, statistics, structural, text, transcripts, triage, trio
from helixframe.sources import annotated, inspection, landed
from helixframe.sources import queries as files
from helixframe.streaming import events

MODULES = (ontology, genotype, kinship, intervals, transcripts, structural, annotation, alignment, resolve, records, names, phrases, cjk_search, triage, trio, consensus, statistics, acmg, text, evaluation, cards, events, files, landed, inspection, annotated)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
FLAGSHIP = "agg05_resnik_rank"
