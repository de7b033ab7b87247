"""Writers: published levels, review extracts and data dictionaries."""
