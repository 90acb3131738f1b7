"""Word lists of the surface features."""

# The lists that the features are defined by.
MACHINE_PHRASES = """it is important to note
it is worth noting
plays a crucial role
plays a vital role
plays a significant role
in today's world
in today's fast-paced
in an ever-changing
ever-evolving
a testament to
serves as a reminder
navigate the complexities
navigating the complexities
delve into
delving into
shed light on
a beacon of
the tapestry of
rich tapestry
at its core
more than just
not merely
not just a
underscores the importance
highlights the importance
fostering a sense of
instilled in me
taught me valuable lessons
valuable lesson
a profound impact
profound understanding
deeply resonated
resonated with me
pivotal moment
defining moment
little did i know
as i reflect
reflecting on this
this experience taught me
i came to realize
i realized that
the power of
embrace the
embark on
embarked on a journey
journey of self-discovery
paved the way
opened my eyes
eye-opening experience
stepping out of my comfort zone
outside my comfort zone
in conclusion
ultimately taught me
continues to shape
shaped who i am
who i am today""".splitlines()
MACHINE_WORDS = """moreover furthermore additionally consequently therefore thus hence crucial pivotal profound invaluable multifaceted nuanced holistic
intricate intricacies myriad plethora realm landscape framework endeavor endeavour aspiration resilience perseverance determination unwavering steadfast relentless meticulous diligent
foster fostering cultivate cultivating harness harnessing leverage transformative empowering enriching fulfilling rewarding showcase showcasing underscore underscores exemplify exemplifies
testament culmination trajectory""".split()
HEDGES = """perhaps maybe possibly probably arguably seemingly apparently somewhat rather quite fairly relatively generally typically usually often sometimes occasionally
suggest suggests indicate indicates tend tends appear appears seem seems might could may""".split()
BOOSTERS = """very extremely incredibly truly deeply utterly absolutely completely entirely thoroughly immensely tremendously significantly substantially
remarkably profoundly undoubtedly certainly definitely clearly obviously""".split()
DISCOURSE = """however therefore moreover furthermore additionally consequently nevertheless nonetheless meanwhile similarly likewise conversely instead besides
accordingly subsequently ultimately overall finally firstly secondly thirdly""".split()
FUNCTION_WORDS = """a an the and or but if while of to in on at by for with about against between into through during before after above below from up down out off over under
again further then once here there all any both each few more most other some such no nor not only own same so than too very can will just should now
i me my myself we us our ours ourselves you your yours he him his she her hers it its they them their what which who whom this that these those am is are was
were be been being have has had having do does did doing would could shall""".split()
CONCRETE = """monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december
morning afternoon evening midnight noon""".split()
# Words that open a clause, and words of the first person.
CLAUSE_MARKERS = "that which who whom whose because although though while whereas since unless until whether if when where after before as".split()
FIRST_PERSON = "i me my mine myself we us our ours".split()
# Typography by collection method, each brought to one form.
TYPOGRAPHY_ONE = {"‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"', "‟": '"', "′": "'", "″": '"', " ": " ", " ": " ", " ": " ", " ": " "}
TYPOGRAPHY_DASHES, ELLIPSIS, ZERO_WIDTH = "–—―", "…", "​﻿"
# Feature names whose joint deviation is the style gap.
STYLE_KEYS = "mean_logprob logprob_sd mean_log_rank curvature mean_word_len comma_rate subordination_rate function_word_rate discourse_marker_rate root_ttr n_words".split()
