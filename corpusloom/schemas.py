"""Declared schemas of the corpus datasets, as DDL."""

DICTIONARY = "lema string, cat string, glosa string"
FIRST_ALIGNED = "idx int, verso_num int, texto_inga string, texto_es string"
NT_TARGET = "libro string, capitulo int, versiculo int, texto_inga string, verso_combinado boolean"
NT_SOURCE = "libro string, capitulo int, versiculo int, texto_es string"
OT_TARGET = "libro string, capitulo int, versiculo int, texto_inga string"
PARALLEL = "idx int, libro string, capitulo int, versiculo int, texto_inga string, texto_es string, dialecto string, fuente string"
STORY_SENTENCES = "idx int, texto_inga string, texto_es string, dialecto string, fuente string, historia int"
LOSS_HISTORY = "step int, loss double, eval_loss double"
LEXICON_INDEX = DICTIONARY + ", text string, vector array<float>"
GRAMMAR_INDEX = "text string, fuente string, chunk_id int, vector array<float>"
EXAMPLE_INDEX = "text string, texto_inga string, texto_es string, libro string, capitulo int, versiculo int, vector array<float>"
METRICS = "map<string, struct<bleu: double, chrf: double, bertscore: double>>"
