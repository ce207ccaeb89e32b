"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage, and it can be removed
without touching the point-in-time engine.

=====================  =======================================================
module                 operator
=====================  =======================================================
``mixing``             mixing sources to target weights (Sainte-Lague quotas)
``langid``             language identification (hashed subword embeddings)
``chat``               chat formatting (role automaton, loss mask)
``lm``                 n-gram scoring (Elias-Fano trie)
``toxicity``           multiple-instance toxicity (noisy-or of sentences)
``suffixdedup``        repeated passages (suffix array by Lyndon grouping)
``topk``               exact top-k search (impact-ordered, score at a time)
``bpe``                byte-level BPE encoding and decoding
``neardup``            near duplicates (SuperMinHash, banding, verification)
``quality``            quality rules (hashed n-gram log-likelihood ratio)
=====================  =======================================================
"""
