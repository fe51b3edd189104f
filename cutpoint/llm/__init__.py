"""Training-data operators: mixing, deduplication, classification, scanning, decontamination."""
