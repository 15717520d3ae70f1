"""The finance lexicon: keyword, polarity, strength."""

# Word list with polarity and strength, one entry per line, in alphabetical order.
FINANCE_LEXICON = """
accelerating,positive,1.4
acquisition,positive,1.6
adoption,positive,1.6
advises,positive,1.2
ai breakthrough,positive,1.7
all time high,positive,1.6
all-time high,positive,1.6
allocation,positive,1.3
approval,positive,1.5
avoid,negative,1.5
backlog,positive,1.3
bankruptcy fears,negative,1.8
bankruptcy,negative,1.8
bearish,negative,1.3
beat expectations,positive,1.5
beat,positive,1.4
best buy,positive,1.5
best stock,positive,1.5
best,positive,1.3
bets on,positive,1.4
bottoming,positive,1.3
breakthrough drug,positive,1.7
breakthrough,positive,1.5
bubble,negative,1.6
bull case,positive,1.4
bullish,positive,1.4
buy,positive,1.2
buying opportunity,positive,1.6
buying,positive,1.2
buyout,positive,1.7
cash burn,negative,1.4
cash flow,positive,1.3
cash generation,positive,1.4
cash position,positive,1.3
catalyst,positive,1.4
competitive advantage,positive,1.4
competitive moat,positive,1.5
consumer confidence,positive,1.3
contract win,positive,1.6
contract,positive,1.5
crash,negative,1.7
deal secured,positive,1.5
deal,positive,1.4
debt free,positive,1.5
debt reduction,positive,1.3
debt,negative,1.2
decline,negative,1.3
default,negative,1.7
delay,negative,1.2
demand,positive,1.2
digital transformation,positive,1.4
dilution,negative,1.3
disruption,negative,1.2
diversified,positive,1.3
dividend cut,negative,1.4
dividend increase,positive,1.4
downgrade,negative,1.5
drop,negative,1.3
earnings beat,positive,1.6
earnings growth,positive,1.5
earnings miss,negative,1.7
efficiency,positive,1.3
endorsement,positive,1.5
executive departure,negative,1.4
expansion,positive,1.4
fda approval,positive,2.0
fear,negative,1.3
forecast raised,positive,1.5
fraud,negative,1.8
free cash flow,positive,1.4
gains,positive,1.3
growth,positive,1.4
guidance beat,positive,1.5
guidance cut,negative,1.6
guidance lowered,negative,1.5
guidance raise,positive,1.6
hemorrhaging,negative,1.9
hidden gem,positive,1.5
high growth,positive,1.5
improving,positive,1.3
inflection point,positive,1.5
innovation,positive,1.4
institutional,positive,1.6
into million,positive,1.7
investigation,negative,1.4
investor optimism,positive,1.4
joint venture,positive,1.4
keep running,positive,1.4
keeps running,positive,1.4
lawsuit,negative,1.4
layoff,negative,1.5
leading,positive,1.3
losing,negative,1.3
loss,negative,1.3
made millionaires,positive,1.8
margin expansion,positive,1.4
margin improvement,positive,1.4
market leader,positive,1.5
market opportunity,positive,1.4
market share,positive,1.3
merger,positive,1.6
milestone,positive,1.5
millionaire,positive,1.6
miss expectations,negative,1.5
miss,negative,1.3
moat,positive,1.4
momentum shift,positive,1.4
momentum,positive,1.3
new product,positive,1.4
once in a decade,positive,1.8
operating leverage,positive,1.4
opportunity,positive,1.3
outlook raised,positive,1.5
outperform,positive,1.5
overlooked,positive,1.3
panic,negative,1.4
partnership deal,positive,1.6
partnership,positive,1.4
plunge,negative,1.5
positioned,positive,1.2
price target,positive,1.4
pricing power,positive,1.4
product launch,positive,1.5
profit growth,positive,1.5
profit warning,negative,1.7
profit,positive,1.4
profitable,positive,1.4
rally,positive,1.4
rate cuts,positive,1.3
reach,positive,1.2
rebound,positive,1.3
recall,negative,1.4
recession,negative,1.5
recommend,positive,1.4
record breaking,positive,1.7
record revenue,positive,1.7
record,positive,1.5
recovering,positive,1.3
recovery,positive,1.4
regulatory approval,positive,1.5
regulatory setback,negative,1.4
resilient,positive,1.3
restructuring,negative,1.3
revenue beat,positive,1.5
revenue decline,negative,1.4
revenue growth,positive,1.4
rise,positive,1.3
robust,positive,1.3
sales growth,positive,1.4
scale,positive,1.2
scandal,negative,1.7
secured,positive,1.4
sell rating,negative,1.4
selloff,negative,1.5
share buyback,positive,1.5
shortage,negative,1.3
slowdown,negative,1.3
slump,negative,1.4
soar,positive,1.5
speculative,negative,1.5
stable,positive,1.2
stimulus,positive,1.3
stock split,positive,1.3
strong buy,positive,1.5
strong earnings,positive,1.6
strong forecast,positive,1.6
strong,positive,1.3
success story,positive,1.6
success,positive,1.4
supply chain,negative,1.2
surge,positive,1.5
tailwind,positive,1.4
takeover,positive,1.7
target,positive,1.3
top stock,positive,1.5
top,positive,1.3
turnaround,positive,1.4
turned into,positive,1.6
uncertainty,negative,1.3
underperform,negative,1.4
undervalued,positive,1.5
upgrade,positive,1.4
validates,positive,1.4
volatility,negative,1.2
vulnerable,negative,1.3
weak earnings,negative,1.5
weak,negative,1.3
win,positive,1.3
winner,positive,1.4
worst,negative,1.4
"""

# The lexicon used when none is given.
FALLBACK_LEXICON = """
growth,positive,1.0
profit,positive,1.0
surge,positive,1.0
bullish,positive,1.0
loss,negative,1.0
drop,negative,1.0
decline,negative,1.0
bearish,negative,1.0
"""


def parse(block: str) -> list[tuple[str, str, float]]:
    """Rows of a block above."""
    rows = (line.split(",") for line in block.strip().splitlines())
    return [(word, polarity, float(strength)) for word, polarity, strength in rows]
