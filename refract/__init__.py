"""refract: a Spark-native toolkit for building and scoring retrieval test
sets over article collections.

Layout
------
sources/    table loaders, row identity, file sources and sinks
functions/  column-expression builders (text, vectors, prompts, HTML)
operators/  multi-stage DataFrame operators (generation, embedding,
            vector index, nearest-neighbour join, evaluation)
plans/      end-to-end plans and the registered query catalogue
streaming/  micro-batch adapter for the vector-index upsert
"""

__version__ = "0.1.0"
