"""Hand-labelled URLs that the URL filter learns from: fixed values, none on a host of the test pages."""

BLOCKED = """
https://cheap-viagra-online.com/order http://www.buy-cialis-cheap.net/ https://discount-pharmacy-rx.biz/pills http://pillstore24.info/buy/3 https://canadian-meds-shop.top/cart
http://herbal-enlargement.xyz/offer https://weight-loss-miracle.club/deal http://www.fat-burner-pills.online/order https://steroids4sale.com/buy http://generic-meds-direct.biz/checkout
https://royal-casino-bonus.com/play http://www.luckyslots777.net/spin https://online-poker-king.top/join http://bet-and-win-big.club/odds https://jackpot-city-casino.xyz/register
http://free-spins-daily.info/claim https://sportsbetting-tips.biz/tips http://roulette-winner.online/go https://crypto-casino-games.com/deposit http://www.bingo-cash-prizes.net/play
https://live-betting-365.top/bet http://lotto-winner-claim.info/prize https://slotmachine-free.club/bonus http://gambling-wager.biz/wager https://blackjack-vip.xyz/table
http://payday-loan-fast.com/apply https://instant-cash-advance.net/apply-now http://bad-credit-loans.biz/approve https://debt-relief-now.top/form http://easy-money-home.club/start
https://get-rich-quick.xyz/join http://forex-profit-robot.info/trial https://binary-options-signals.online/signup http://crypto-doubler.top/invest https://bitcoin-profit-system.club/register
http://work-from-home-cash.biz/go https://make-money-fast.info/now http://free-gift-cards.xyz/claim https://win-iphone-free.club/survey http://prize-winner-today.top/redirect
https://hot-adult-cams.com/live http://www.xxx-porn-videos.net/watch https://sexy-dating-singles.top/meet http://escort-girls-city.biz/book https://adult-webcam-chat.xyz/room
http://free-porn-tube.club/clip https://milf-hookup-tonight.info/join http://nude-celebs.online/gallery https://erotic-massage-ads.biz/list http://xxx-chat-room.com/enter
https://replica-watches-shop.com/rolex http://fake-designer-bags.net/buy https://cheap-rolex-outlet.biz/sale http://knockoff-handbags.top/cart https://discount-sunglasses-outlet.club/offer
http://cheap-jerseys-wholesale.info/shop https://brand-shoes-discount.xyz/deal http://counterfeit-id-cards.biz/order https://fake-diploma-store.online/buy http://essay-writing-cheap.top/order
https://buy-instagram-followers.com/pack http://seo-backlinks-cheap.net/order https://pagerank-booster.biz/links http://article-spinner.top/tool https://traffic-bot-clicks.xyz/buy
http://link-farm-network.info/submit https://email-spam-lists.club/download http://bulk-mailer-pro.biz/trial https://guest-post-links.online/price http://doorway-pages.top/generate
https://ad-tracker-pixel.com/track http://popunder-network.net/serve https://banner-ads-click.biz/click http://adserver-sync.top/pixel https://clickbait-affiliate.xyz/go
http://tracking-beacon.info/b.gif https://retarget-ads.club/match http://malvertising-hub.biz/load https://affiliate-leads.online/offer http://push-notification-ads.top/subscribe
https://free-download-crack.com/setup http://warez-keygen.net/serial https://pirate-movies-free.biz/stream http://hacked-accounts.top/buy https://phishing-login-verify.xyz/account
http://secure-bank-verify.info/login https://your-account-suspended.club/confirm http://virus-alert-support.online/call https://free-antivirus-scan.biz/download http://toolbar-installer.top/run
"""
PLAIN = """
https://www.harbor-news.com/local/12 https://city-library.org/catalogue http://www.science-museum.org/exhibits/4 https://university-press.edu/books/88 http://garden-club.org/roses
https://mountain-weather.gov/forecast http://www.history-archive.org/records/1890 https://cooking-school.com/recipes/soup http://chess-federation.org/rules https://open-maps.org/tiles
https://kernel-docs.org/manual http://python-tutorial.io/lesson/3 https://linux-forum.org/thread/991 http://www.database-guide.com/index.html https://software-journal.org/issue/7
http://physics-lab.edu/papers/2 https://biology-notes.org/cells http://www.math-olympiad.org/problems https://astronomy-society.org/stars http://geology-survey.gov/maps/12
https://town-council.gov/minutes http://www.health-service.gov/clinics https://county-court.gov/cases/33 http://tax-office.gov/forms https://parliament-records.gov/debates
http://railway-timetable.co.uk/london https://airport-arrivals.com/today http://www.bus-routes.org/line/5 https://hiking-trails.org/alps http://camping-guide.com/lakes
https://travel-diary.net/japan http://www.hotel-reviews.com/paris https://youth-hostel.org/berlin http://ferry-line.com/schedule https://bicycle-touring.org/routes
http://classical-radio.org/program https://jazz-festival.com/lineup http://www.film-institute.org/archive https://theatre-royal.co.uk/season http://art-gallery.org/modern
https://poetry-foundation.org/poems/17 http://novel-reviews.com/latest https://grammar-handbook.org/verbs http://www.dictionary-online.org/word https://translation-studies.edu/journal
http://primary-school.edu/classes https://teacher-resources.org/worksheets http://www.student-union.org/events https://evening-college.edu/courses http://learning-centre.org/library
https://football-league.com/table http://www.swimming-club.org/times https://tennis-academy.com/coaches http://running-group.org/results https://ski-resort.com/snow
http://farm-almanac.org/harvest https://bird-watching.org/sightings http://www.ocean-research.org/whales https://forest-service.gov/trees http://animal-shelter.org/adopt
https://family-doctor.org/advice http://www.dental-clinic.com/hours https://hospital-trust.org/wards http://nursing-journal.org/volume/9 https://blood-donors.org/centres
http://kitchen-recipes.com/bread https://baking-blog.com/cakes http://www.wine-region.com/tours https://cheese-makers.org/members http://coffee-roasters.com/beans
https://house-builders.org/plans http://furniture-makers.com/chairs https://electric-company.com/outages http://www.water-utility.gov/quality https://recycling-centre.org/hours
http://local-church.org/services https://village-fair.org/stalls http://www.charity-fund.org/report https://volunteer-network.org/join http://peace-institute.org/essays
https://stock-exchange.com/quotes http://central-bank.gov/rates https://business-daily.com/markets http://trade-union.org/news https://farmers-market.org/vendors
"""
