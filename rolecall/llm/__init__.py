"""Training-data operators: near copies, decontamination, scans, scoring, search and packing."""
