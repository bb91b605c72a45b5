"""Training-data operators: classifiers, joins, tokenizers, language models, packing and fingerprints.

Nothing outside this subpackage imports it. Each operator lives in a module of its own, with its own general interface;
``registry`` has the thin queries ``opN_<name>`` and their SQL.
"""
