"""Training-data operators: tokens, packing, classifiers, language models, neighbours and duplicates.

Nothing else in the library imports this package.
"""
