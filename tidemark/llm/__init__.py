"""Training-data operators: packing, language ID, near-duplicate search,
sharding, chat formatting, HTML extraction, decontamination, URL lists and
quality scoring. Nothing outside this subpackage imports it."""
