"""The document tree as Spark types: document, page, block, child block, line, span."""

from __future__ import annotations

SPAN = "struct<type:string,content:string,image_path:string,html:string,bbox:array<double>>"
LINE = f"struct<bbox:array<double>,spans:array<{SPAN}>>"
CHILD = f"struct<type:string,index:double,bbox:array<double>,lines:array<{LINE}>>"
BLOCK = f"struct<type:string,sub_type:string,guess_lang:string,level:int,index:double,bbox:array<double>,lines:array<{LINE}>,blocks:array<{CHILD}>>"
PAGE = f"struct<page_idx:int,page_size:array<double>,para_blocks:array<{BLOCK}>,discarded_blocks:array<{BLOCK}>,preproc_blocks:array<{BLOCK}>>"
DOCUMENT = f"struct<pdf_info:array<{PAGE}>,_backend:string,_version_name:string>"

#: The block type of each detector label.
LABELS = {
    "abstract": "abstract", "aside_text": "aside_text", "chart": "chart", "content": "index", "display_formula": "interline_equation", "doc_title": "doc_title",
    "figure_title": "caption", "footer": "footer", "footer_image": "footer", "footnote": "page_footnote", "formula_number": "formula_number", "header": "header",
    "header_image": "header", "image": "image", "number": "page_number", "paragraph_title": "paragraph_title", "reference_content": "ref_text",
    "table": "table", "text": "text", "vertical_text": "vertical_text", "vision_footnote": "footnote",
}
#: Types that leave the reading flow, and the visual ones.
DISCARDED = ("header", "footer", "page_number", "aside_text", "page_footnote")
VISUAL = ("table", "image", "chart")
