"""Sources of pages, rules and sitemaps."""
