"""twinspan: duplicated-content analytics on Spark DataFrames.

Files are cut into line-addressed fragments, fragments into tokens, tokens into
fingerprints, and fragments are related to each other by fingerprint grouping, a
lossless weighted similarity join, cosine joins and behavioural evidence.
"""
