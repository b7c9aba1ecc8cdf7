"""Declared schemas of the tables."""

CHUNK = (
    "id long, book_file string, book_title string, pdf_page int, printed_page int, part string, chapter string, article_numbers array<string>, "
    "article_title string, mentions array<string>, section_type string, text string, search_text string"
)
PAGE = "book_file string, pdf_page int, text string"
BOOK = "file string, title string, kind string, include boolean, language string, note string"
EVAL_QUESTION = "q string, articles array<string>, keywords array<string>, refuse boolean"
TURN = "array<struct<role:string,content:string>>"
