"""Operations of a training-data pipeline: one module for each operator.

``quality`` (1), ``chat`` (2), ``secrets`` (3), ``pieces`` (4), ``simhash`` (5), ``urls`` (6), ``topk`` (7),
``mixing`` (8), ``token_store`` (9) and ``rules`` (10). ``queries`` holds the registered queries and their SQL.
Nothing outside this package imports it.
"""
