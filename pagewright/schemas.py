"""Record types of the engine, as Spark DDL. Coordinates in points grow upwards, those in pixels (px) downwards."""

#: A character as it is drawn; `anno` marks a space that no character stands for.
CHAR = "doc_id long, page int, line_no int, glyph_no int, text string, upright boolean, anno boolean, italic boolean, bold boolean, size double, x0 double, x1 double, y0 double"
GLYPH = "text string, italic boolean, bold boolean, size double, x0 double, x1 double, y0 double, sup boolean, marker string, note long, ocr boolean"
GLYPH_ROWS = f"doc_id long, page int, row_no int, glyph_no int, {GLYPH}"
#: A stretch of one style within a row; note is the note that a raised one refers to.
RUN = "struct<text:string,italic:boolean,bold:boolean,sup:boolean,ocr:boolean,note:bigint>"
#: A visual row; hang is where the text after a list label begins; frame_lo and frame_hi are the sides of its column, if any.
ROW = f"doc_id long, page int, row_no int, runs array<{RUN}>, x0 double, x1 double, top double, bottom double, size double, baseline double, frame_lo double, frame_hi double, fuzzy boolean, hang double"
RULE = "struct<x0:double,x1:double,y:double>"
PAGE = f"doc_id long, page int, pdf_page int, part string, width double, height double, rules array<{RULE}>, folio string, scanned boolean"
BLOCK = "doc_id long, block long, kind string, level int, hang double, page_marks map<int,string>"
#: A recognised word, in pixels.
WORD = "doc_id long, page int, block_num int, par_num int, line_num int, word_num int, left int, top int, width int, height int, conf double, text string"
HOCR_LINE = "doc_id long, page int, line_no int, bbox array<double>, slope double, offset double, x_size double, words array<struct<bbox:array<double>,conf:double,text:string>>"
SCAN_WORD = "struct<text:string,x0:double,x1:double,italic:boolean,sup_before:string,sup_after:string>"
SCAN_LINE = f"doc_id long, page int, line_no int, words array<{SCAN_WORD}>, x0 double, x1 double, top double, bottom double, baseline double, size double"
SCAN_PAGE = f"doc_id long, page int, rules array<{RULE}>, used_layer boolean"
#: Words in lower case.
LEXICON = "word string"
TOC_ENTRY = "doc_id long, seq int, title string, level int, page int, found_page int"
TOC_LINE = "doc_id long, page int, block_num int, par_num int, line_num int, text string, page_hint int, indent int, height int, prefix string"
#: Grey images are bytes, a byte a pixel, row by row.
REGION = "doc_id long, page int, part string, x0 int, angle double, width int, height int, image binary, plain binary"
BOX = "struct<x:int,y:int,w:int,h:int>"
DETECTION = f"top int, bottom int, kept array<{BOX}>, rejected array<{BOX}>"
SETTINGS = {"lang": "eng", "dpi": 300, "min_conf": 0.0, "font_file": None, "rasterize": True, "jpeg_quality": 85, "drop_running_heads": False, "cleanup": True, "split_spreads": False}
