"""Named queries; importing ``all_queries`` registers every one of them."""
