"""Analytics over collections of critical reviews, as DataFrame to DataFrame transforms."""
