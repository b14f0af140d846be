"""Where files come from: folders, archives, pages, datasets, stores, shards."""
