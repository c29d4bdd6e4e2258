"""Imports every module that registers queries."""

from quire.plans import q_files, q_layout, q_ocr, q_render, q_tables, q_text, q_visual  # noqa: F401
