"""The engine's operators on tables of pages, under one roof: a DataFrame with HTML in, a DataFrame out."""

from papyrine.convert import clean_table, convert_table, dom_nodes, headings, links, metadata_table, tables
from papyrine.plans.batch import collisions, diagnostics, line_diff, manifest, output_path, records, triage

__all__ = ["clean_table", "collisions", "convert_table", "diagnostics", "dom_nodes", "headings", "line_diff", "links", "manifest", "metadata_table", "output_path", "records", "tables", "triage"]
