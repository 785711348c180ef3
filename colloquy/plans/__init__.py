"""plans of the conversational-search engine."""
