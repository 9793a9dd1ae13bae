"""Training-data operators: packing, licences, near-duplicates, toxicity, fingerprints, BPE, HTML, language, chat."""
