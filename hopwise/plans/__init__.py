"""Options, search-job planning and the end-to-end runs."""
